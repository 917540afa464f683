import glob
import os
import random

import pandas as pd
import pytest

from conftest import rows
from trailmart.llm import formatting_copies as copies
from trailmart.llm import listings, overlap, proportional, survivors

DATA = "/root/testdata/sf0.001"
TASK = "task_id long, difficulty string, domain string, option_bucket string"
TARGET = "difficulty string, domain string, option_bucket string, target_permille int, min_rows int"


def test_proportional(spark):
    tasks = [(i, ["simple", "Simple ", "ｓｉｍｐｌｅ", "hard"][i % 4], "d1" if i % 3 else "d2", "x") for i in range(200)] + [(900, None, "d1", "x"), (901, " ", "d1", "x"), (0, "simple", "d2", "x")]
    targets = [("simple", "d1", "x", 500, 5), ("hard", "d2", "x", 300, 30), ("hard", "none", "x", 200, 1)]
    t, g = spark.createDataFrame(tasks, TASK), spark.createDataFrame(targets, TARGET)
    plan = {(r.difficulty, r.domain): (r.demand, r.available, r.allocated) for r in proportional.allocation(t, g).collect()}
    assert plan["simple", "d1"][0] == 20 and plan["hard", "d2"][0] == 30 and plan["hard", "none"] == (8, 0, 0)
    assert plan["hard", "d2"][1] == plan["hard", "d2"][2] < 30
    assert sum(p[2] for p in plan.values()) == 58  # unmet quota went to other leaves
    sample = proportional.draw(t, g)
    assert sample.count() == 58 and sample.select("task_id").distinct().count() == 58
    assert proportional.draw(t.limit(0), g).count() == 0
    ranked = proportional.permuted_rank(spark.range(5000).selectExpr("id", "'s' AS g"), ["g"], "id", slices=64)
    assert sorted(r.rank for r in ranked.collect()) == list(range(1, 5001))


def test_two_spellings_of_a_stratum_share_it(spark):
    t = spark.createDataFrame([(i, "a", "d", "x") for i in range(10)] + [(50 + i, "b", "d", "x") for i in range(90)], TASK)
    g = spark.createDataFrame([("a", "d", "x", 400, 1), (" A", "ｄ", "X", 400, 8), ("b", "d", "x", 200, 1), (None, "d", "x", 0, 3)], TARGET)
    plan = {r.difficulty: (r.demand, r.available, r.allocated, r.passed_on) for r in proportional.allocation(t, g).collect()}
    assert plan == {"a": (16, 10, 10, 6), "b": (4, 90, 13, 0), None: (3, 0, 0, 3)}
    assert proportional.draw(t, g).count() == 23


def test_allocation_prefers_siblings():
    frame = pd.DataFrame([("a", "d", "x", 10, 4), ("a", "d", "y", 2, 5), ("a", "e", "x", 2, 50), ("b", "d", "x", 1, 100)], columns=["difficulty", "domain", "option_bucket", "demand", "available"])
    got = proportional.allocate(frame).set_index(["difficulty", "domain", "option_bucket"]).allocated.to_dict()
    assert got == {("a", "d", "x"): 4, ("a", "d", "y"): 5, ("a", "e", "x"): 5, ("b", "d", "x"): 1}


def _cell(votes, *records):
    """(value, trust, day) each, records numbered from 0."""
    day, newest = 86_400_000_000, max(d for _, _, d in records) * 86_400_000_000
    return [(v, votes.weight(t, d * day, i, newest), survivors.STRICT.weight(t, d * day, i, newest)) for i, (v, t, d) in enumerate(records)]


def test_consensus():
    r = random.Random(1)
    pool = [0.0, 1.0, 12.0, 123.0, 1234.5, 99.0, 1e6, 0.25, 21.0]
    for _ in range(300):  # strict: the best record wins against any number of lesser ones
        records = [(r.choice(pool), r.randint(1, 3), r.randint(1, 9)) for _ in range(r.randint(1, 12))]
        best = max(range(len(records)), key=lambda i: (-records[i][1], records[i][2], i))
        value, _, order = survivors.survivor(_cell(survivors.STRICT, *records), survivors.STRICT)
        assert (value, order[3]) == (records[best][0], max(i for i, x in enumerate(records) if x[0] == value and x[1:] == records[best][1:]))


def test_graded_votes_add_up():
    pick = lambda *records: survivors.survivor(_cell(survivors.GRADED, *records), survivors.GRADED)[0]
    assert pick((120.0, 1, 9), (350.0, 2, 9)) == 120.0
    assert pick((120.0, 1, 9), (350.0, 2, 9), (350.0, 2, 9), (350.0, 3, 9)) == 350.0  # agreeing records outvote the trusted one
    assert pick((120.0, 1, 1), (350.0, 2, 99)) == 350.0  # the trusted one is old
    assert pick((1500.0, 1, 9), (1520.0, 2, 9), (1620.0, 2, 9), (1920.0, 2, 9)) == 1520.0  # '5' and '2' win in columns of different voters; the closest existing value
    whole = survivors.consensus([survivors.profile(list("12"), 1.0), survivors.profile(list("13"), 0.8), survivors.profile(list("13"), 0.7)], survivors.GRADED)
    assert survivors.winners(whole) == "13" and abs(whole[1] - 2.5) < 1e-9


ROLLOUT = "record_id long, task_id double, rollout_id string, verifier string, written_at timestamp_ntz, verification struct<metrics map<string,double>>"


def test_survivors(spark):
    import datetime as dt

    d = lambda n: dt.datetime(2025, 1, n)
    data = [
        (1, 1.0, "rollout-01", "low", d(5), ({"m": 5.0, "n": 1.0},)), (2, 1.0, "1", "high", d(1), ({"m": float("nan"), "n": 2.0},)), (3, 1.0, "R1", "high", d(2), ({"n": 3.0},)), (4, 1.0, " 1", None, None, ({"k": -1.0},)),
        (5, 1.0, "2", "high", d(1), ({"m": 1.0},)), (5, 1.0, "2", "high", d(1), ({"m": 1.0},)), (6, None, "3", "high", d(1), ({"m": 1.0},)), (7, 2.0, None, "high", d(1), ({"m": 1.0},)),
        (8, 3.0, "0", "odd", None, ({"m": 7.0},)), (9, 3.0, "0", None, None, ({"m": 7.0},)), (10, 3.0, "0", "low", None, None),
    ]
    ranks = spark.createDataFrame([("high", 1), ("low", 2)], "verifier string, trust_rank int")
    got = survivors.survivors(spark.createDataFrame(data, ROLLOUT), ranks)
    assert rows(got.select("task_id", "rollout_no", "metric", "record_id")) == [(1, 1, "m", 1), (1, 1, "n", 3), (3, 0, "m", 9)]
    assert survivors.survivors(spark.createDataFrame([], ROLLOUT), ranks).count() == 0


@pytest.mark.parametrize("votes", ["STRICT", "GRADED"])
def test_hot_group_of_survivors(spark, votes):
    """A group dealt to several tasks gives what one task gives; single records and one record delivered often give nothing."""
    votes = getattr(survivors, votes)
    data = [(i, 1.0, "1", "high" if i % 7 else "low", None, ({"m": float(i % 50), "n": 3.0},)) for i in range(600)]
    data += [(900, 2.0, "1", "high", None, ({"m": 1.0},)), (901, 3.0, "1", "low", None, ({"m": 1.0},)), (902, 3.0, "1", "high", None, ({"m": 2.0},))] + [(903, 4.0, "1", "high", None, ({"m": 1.0},))] * 150
    df, ranks = spark.createDataFrame(data, ROLLOUT), spark.createDataFrame([("high", 1), ("low", 2)], "verifier string, trust_rank int")
    whole, dealt = (rows(survivors.survivors(df, ranks, votes, n)) for n in (5000, 100))
    assert whole == dealt and (3, 1, "m", 902, 2.0) in whole and len(whole) == 3
    if votes is survivors.STRICT:
        assert (1, 1, "m", 599, 49.0) in whole


def test_counting_trie():
    r = random.Random(2)
    words = ["".join(r.choices("ab\xe9", k=r.randint(0, 6))).encode() for _ in range(3000)]
    trie, plain = copies.CountingTrie(), {}
    for i, w in enumerate(words):
        trie.add(w, i)
        plain.setdefault(w, [i, 0])[1] += 1
    assert {t: [k, n] for t, k, n in trie.items()} == plain


@pytest.mark.parametrize("bucket_rows", [3, 20_000])
def test_copies(spark, bucket_rows):
    r = random.Random(3)
    base = [f"买茶壶 {i} 个" for i in range(30)] + ["a", "ab", "abc", ""]
    data = [(i, r.choice([str.upper, str.strip, lambda s: f"「{s}」", lambda s: s.replace(" ", "　")])(base[int(r.random() ** 3 * len(base))])) for i in range(400)]
    df = spark.createDataFrame([*data, (5000, None), data[0]], "id long, text string").repartition(3)
    groups, members = copies.collapse_copies(df, "id", "text", bucket_rows)
    expected = {}
    for i, t in data:
        g = expected.setdefault(copies.canonical(t).text, [i, 0])
        g[0], g[1] = min(g[0], i), g[1] + 1
    assert sorted((g.first_key, g.copies) for g in groups.collect()) == sorted(map(tuple, expected.values()))
    assert members.count() == len(data)
    assert copies.collapse_copies(df.limit(0), "id", "text")[0].count() == 0


def test_a_shared_start_costs_one_level(spark):
    start = "x" * 10_000
    data = [(i, start + f"{i % 900:04d}" + "y" * (i % 3)) for i in range(1000)] + [(5000 + i, start) for i in range(40)]
    local = spark.createDataFrame([(t.encode(), i, 1) for i, t in data], copies.LOCAL)
    placed, levels = copies.radix_buckets(local, 20)
    assert levels <= 3 and placed.count() == len(data)
    sizes = [r["count"] for r in placed.groupBy("bucket").count().collect()]
    assert sorted(sizes)[-1] == 40 and sorted(sizes)[-2] <= 20  # rows of one text can't be told apart
    groups = {r.first_key: r.copies for r in copies.counted_groups(local, 20).collect()}
    expected = {}
    for i, t in data:
        expected.setdefault(t, []).append(i)
    assert groups == {min(v): len(v) for v in expected.values()}


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            ahead, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                ahead, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, ahead + (x != y))
        return row[-1]

    r = random.Random(4)
    for _ in range(500):
        a, b = ("".join(r.choices("abc茶", k=r.randint(0, 90))) for _ in range(2))
        assert overlap.edit_distance(a, b) == plain(a, b)


def test_overlap_against_all_pairs(spark):
    r = random.Random(5)

    def edited(s, k):
        s = list(s)
        for _ in range(k):
            i = r.randrange(len(s))
            if not s[i].isdigit():
                s[i] = r.choice(["谢", "", "x"]) if r.random() < 0.7 else s[i] * 2
        return "".join(s)

    letters = "茶壶杯碗盘勺锅灯椅桌床柜门窗纸笔书包鞋帽衣裤伞表"
    base = ["".join(r.choices(letters, k=60)) + f"{r.randint(1, 4)}个" for _ in range(25)]
    data = [(i, r.choice(["train", " TRAIN", "eval", "Test\n", "online_dev", "reserve", None]), "s", edited(r.choice(base), r.choice([0, 2, 5, 14]))) for i in range(260)]
    df = spark.createDataFrame([*data, (999, "train", "s", None), data[0]], "task_id long, tag string, source string, instruction string")
    got = {tuple(sorted((x.train_id, x.held_id))) for x in overlap.overlaps(df).collect()}
    side = lambda t: None if t is None else t.strip().lower()
    forms = {i: overlap.canonical(t) for i, _, _, t in data}
    want = set()
    for i, ti, *_ in data:
        for j, tj, *_ in data:
            if side(ti) == "train" and side(tj) in overlap.HELD_OUT:
                a, b = forms[i], forms[j]
                x, y = overlap.in_one_order(a.fields, b.fields)
                if a.text == b.text or a.numbers == b.numbers and overlap.edit_distance(x, y) <= overlap.MOST_EDITS * max(len(x), len(y)):
                    want.add(tuple(sorted((i, j))))
    assert got == want and len(want) > 100
    assert overlap.overlaps(df.limit(0)).count() == 0


def test_overlap_without_numbers(spark):
    """One block of 2,000 texts without numbers: few candidates a class, and no near pair is missed."""
    r = random.Random(6)
    parts = ["".join(r.sample("轻便防水耐磨静音透气省电折叠柔软抗摔滑茶壶耳机键盘杯书包台灯卧室厨房办公露营地红蓝米白墨绿", 2)) for _ in range(60)]
    base = ["想买一个" + "".join(r.choices(parts, k=14)) + "的，尽快发货" for _ in range(1900)]
    data = [(i, r.choice(["train", "eval"]), "s", t) for i, t in enumerate(base)]
    for k in range(100):
        t = list(base[k])
        for _ in range(4):
            t[r.randrange(len(t))] = r.choice("甲乙丙丁")
        data.append((5000 + k, "eval" if data[k][1] == "train" else "train", "s", "".join(t)))
    df = spark.createDataFrame(data, "task_id long, tag string, source string, instruction string")
    texts = overlap.class_texts(overlap.classed(df))
    assert texts.select("classes").distinct().count() == 1 and overlap.bands_of(2000)[0] > 2
    assert overlap.candidate_pairs(texts).count() < 50 * len(data)
    got = {tuple(sorted((x.train_id, x.held_id))) for x in overlap.overlaps(df).collect()}
    assert {(k, 5000 + k) for k in range(100)} <= got


PRODUCT = "listing_id long, title string, brand string, attributes array<string>"


def test_listings(spark):
    brands = spark.createDataFrame([(1, "Rhiebb", "瑞艾"), (2, "Zomfro", "佐弗")], "brand_id int, latin_name string, zh_name string")
    data = [
        (1, "瑞艾 CQ-6021 显示器 36W 4.5kg", "Rhiebb官方", ["材质: ABS"]), (2, "[Sale]/RHIEBB/cq6021/Monitor/36 watts", None, ["重量: 4500克"]), (3, "瑞艾 CQ 6021 Pro 显示器 36W 4.5kg", "瑞艾", None),
        (4, "瑞艾 CQ6021 显示器 65W 4.5kg", "瑞艾", None), (5, "佐弗 CQ6021 显示器 36W 4.5kg", "佐弗", None), (6, "瑞艾 槿茉竹系列 保温杯 1L 0.5斤", "瑞艾", None), (7, "Rhiebb 槿茉竹 保温杯 1000ml 250g", None, []),
        (8, "瑞艾 槿茉竹 ProMax 保温杯 1L 250g", "瑞艾", None), (9, None, "瑞艾", None), (10, "no brand at all", None, None), (11, "Сq6021 瑞艾 显示器 36Ｗ 9斤", None, None), (1, "瑞艾 CQ-6021 显示器 36W 4.5kg", "Rhiebb官方", ["材质: ABS"]),
        (12, "瑞艾 ZZ-1111 保温杯 1L", "瑞艾", None), (13, "瑞艾 显示器 cq6021 36W", "瑞艾", ["重量= 4.5KG", ""]),
    ]
    found = listings.items(spark.createDataFrame(data, PRODUCT), brands)
    by_item = {}
    for r in found.collect():
        by_item.setdefault((r.brand_id, r.model, r.specs), set()).add(r.listing_id)
    assert {frozenset(v) for v in by_item.values() if len(v) > 1} == {frozenset({1, 2, 11, 13}), frozenset({6, 7})}
    assert listings.items(spark.createDataFrame([], PRODUCT), brands).count() == 0


def test_specifications():
    got = listings.specifications([listings.plain("1.２KW 16G 300g 0.5升 x3"), "pack of 3", listings.plain("2TB 34公分"), "500毫升"])
    assert got == {"power": [1200.0], "memory": [16.0, 2048.0], "weight": [300.0], "volume": [500.0], "count": [3.0], "length": [340.0]}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_every_query_runs_and_agrees_with_sql(spark):
    import duckdb

    from trailmart.llm import queries

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    for name, query in queries.QUERIES.items():
        df = query(spark, DATA)
        got = df.collect()
        if name in queries.ORACLES:
            found = con.execute(queries.ORACLES[name])
            order = [[d[0] for d in found.description].index(c) for c in df.columns]
            assert sorted(tuple(r[i] for i in order) for r in found.fetchall()) == sorted(map(tuple, got)), name


def test_blocks_of_any_size_miss_as_few_pairs():
    for classes in (1, 200, 201, 2_000, 100_000, 10**9):
        rows, bands = overlap.bands_of(classes)
        assert (1 - overlap.WORST**rows) ** bands <= 0.00031
