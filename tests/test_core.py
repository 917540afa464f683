import json
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from trailmart.functions import fuzzy
from trailmart.functions.html import visible_text
from trailmart.functions.text import letters_and_digits, long_ids, model_numbers, nfkc_casefold, path_parts, query_text, search_tokens, short_code
from trailmart.operators import catalog, metrics, sampling
from trailmart.operators import conversations as conv
from trailmart.operators.search import build_index, page_of, search, swapped_pages


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_text(spark):
    lit = F.lit
    assert one(spark, query_text(lit(" 迷你，冰箱 100 CNY "))) == "迷你 冰箱 100元"
    assert one(spark, search_tokens(lit("小冰箱"))) == ["小冰", "冰箱"]
    assert one(spark, search_tokens(lit("茶 X-100 x-100 a.b"))) == ["茶", "x-100", "a.b"]
    assert one(spark, search_tokens(lit(None).cast("string"))) == [] and one(spark, search_tokens(lit(""))) == []
    assert one(spark, model_numbers(lit("Cam A7-III x100 500"))) == ["x100", "a7-iii"] or set(one(spark, model_numbers(lit("Cam A7-III x100 500")))) == {"a7-iii", "x100"}
    assert one(spark, letters_and_digits(lit("Ａ-b 1.5!"), nfkc_casefold)) == "ab15"
    assert one(spark, path_parts(lit(" a › b>c//"))) == ["a", "b", "c"]
    assert one(spark, long_ids(lit("x 12345 0123456789 0123456789 012345678901234567890"))) == ["0123456789"]
    assert len(one(spark, short_code(lit("x")))) == 10
    assert one(spark, nfkc_casefold(lit("Straße"))) == "strasse"


def test_fuzzy():
    assert fuzzy.token_set_ratio("red cotton shirt", "shirt red") == 100
    assert fuzzy.token_set_ratio("", "a") == 0 and fuzzy.partial_ratio("abc", "xxabcxx") == 100
    assert fuzzy.partial_ratio("", "") == 100 and fuzzy.partial_ratio("", "a") == 0
    assert 60 < fuzzy.ratio("kitten", "sitting") < 70
    assert not fuzzy.numbers_agree("50W", "500W") and not fuzzy.numbers_agree("50W", "watt") and fuzzy.numbers_agree("watt", "50W")
    assert fuzzy.matched_share([], ["a"]) == 1.0 and fuzzy.matched_share([None, " "], None) == 1.0 and fuzzy.matched_share(["a"], None) == 0.0
    assert fuzzy.matched_share(["50W", None], ["500W"]) == 0.0
    assert fuzzy.matched_share(["500w 电机"], ["w 电机"]) == 0.0  # numbers against none
    assert fuzzy.matched_share(["ＡＢＣ"], ["abc"]) == 1.0
    assert fuzzy.matched_share(["防水耐磨"], ["防水", "耐磨"]) == 1.0 and fuzzy.matched_share(["防水5"], ["防水", "x"]) == 0.0  # joined texts serve words only
    assert fuzzy.matched_share(["50瓦", "防水"], ["500瓦", "防水"]) == 0.5 and fuzzy.matched_share(["亮银50W"], ["高亮500W"]) == 0.0
    assert fuzzy.token_set_matches(["dark navy 5"], ["dark 7"]) == 1.0  # one colour; no guard of numbers here
    assert fuzzy.attribute_matches(["red cotton", "easy wash"], ["cotton red"], ["very Easy Wash cloth", None]) == 1.0 and fuzzy.attribute_matches(["x"], None, None) == 0.0
    assert fuzzy.first_colour("") == "" and fuzzy.first_colour("米白") == "米白"


def test_html():
    html = "<html><head><title>t</title></head><body>A<script>x()</script><p>b &amp; c<br>d</p><button>Buy</button><!-- no --></body>"
    assert visible_text(html) == "A [SEP] b & c [SEP] d [SEP] Buy"
    assert visible_text(html, rich=True).endswith("[button] Buy [button_]")
    assert visible_text("") == "" and visible_text("<p>open") == "open"


def test_search_against_plain_python(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 6))), " ".join(r.choices(words, k=2))) for i in range(40)]
    asked = [(100, "w1 w2"), (101, "w3"), (102, ""), (103, "none"), (104, "w4 w4 w5 w6")]
    weights = {"title": 3.0, "body": 0.5}
    index = build_index(spark.createDataFrame(docs, "id long, title string, body string"), "id", weights)
    got = {(x.query, x.doc): (x.score, x.rank) for x in search(index, spark.createDataFrame(asked, "q long, text string"), "q", "text", depth=5).collect()}
    tf, length = {}, {}
    for i, title, body in docs:
        fields = [(set(title.split()), 3.0), (set(body.split()), 0.5)]
        length[i] = sum(len(s) for s, _ in fields)
        for s, w in fields:
            for t in s:
                tf[i, t] = tf.get((i, t), 0) + w
    mean = sum(length.values()) / len(docs)
    for q, text in asked:
        scores = {}
        for i, *_ in docs:
            for t in set(text.split()):
                if (i, t) in tf:
                    n = sum((d, t) in tf for d in length)
                    idf = math.log((len(docs) - n + 0.5) / (n + 0.5))
                    idf = idf if idf > 0 else 1e-6
                    f = tf[i, t]
                    scores[i] = scores.get(i, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[i] / mean))
        best = sorted(((-round(s, 6), i) for i, s in scores.items()))[:5]
        assert [(i, k) for k, (_, i) in enumerate(best, 1)] == [(d, k) for k, d in sorted((v[1], d) for (a, d), v in got.items() if a == q)]
    with pytest.raises(ValueError):
        build_index(spark.range(1).select(F.lit("a").alias("t")), "t", {"t": 0.0})


def test_pages(spark):
    hits = spark.createDataFrame([(1, d, d) for d in range(1, 51)] + [(2, d, d) for d in range(1, 31)], "query int, doc int, rank int")
    assert [r.doc for r in page_of(hits, 3).orderBy("doc").collect()] == list(range(41, 51))
    swapped = {(r.query, r.doc): r.rank for r in swapped_pages(hits).collect()}
    assert swapped[1, 1] == 21 and swapped[1, 21] == 1 and swapped[1, 41] == 41 and swapped[2, 1] == 1


def greedy(sizes, total):
    """Largest remainder by single steps, from its definition."""
    cap = sum(n for _, n in sizes)
    ideal = {k: total * n / cap for k, n in sizes}
    out = {k: min(n, max(1, math.floor(ideal[k]))) for k, n in sizes}
    size = dict(sizes)
    while sum(out.values()) < total:
        k = max((k for k in out if out[k] < size[k]), key=lambda k: (ideal[k] - out[k], k))
        out[k] += 1
    while sum(out.values()) > total:
        k = min((k for k in out if out[k] > 1), key=lambda k: (ideal[k] - out[k], k))
        out[k] -= 1
    return out


def test_largest_remainder(spark):
    r = random.Random(5)
    for _ in range(12):
        sizes = [(f"k{i:02d}", r.randint(1, r.choice([3, 200]))) for i in range(r.randint(1, 9))]
        total = r.randint(len(sizes), sum(n for _, n in sizes))
        got = sampling.largest_remainder(spark.createDataFrame(sizes, "k string, n long"), ["k"], "n", total)
        assert {x.k: x.allocated for x in got.collect()} == greedy(sizes, total)
    few = spark.createDataFrame([("a", 2)], "k string, n long")
    assert sampling.largest_remainder(few, ["k"], "n", 3).count() == 0


def test_samples_and_splits(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("g"))
    sample = sampling.stratified_sample(df, ["g"], "id", 100)
    assert sample.count() == 100 and rows(sample) == rows(sampling.stratified_sample(df.repartition(5), ["g"], "id", 100))
    places = sampling.ranked(df, ["g"], "id", 1).groupBy("g").agg(F.countDistinct("place").alias("d"), F.max("place").alias("m"), F.count("*").alias("n"))
    assert all(r.d == r.m == r.n for r in places.collect())
    splits = {r.split: r["count"] for r in sampling.disjoint_splits(df, "g", "id", {"a": 0.5, "b": 0.3, "c": 0.2}).groupBy("split").count().collect()}
    assert sum(splits.values()) == 1000 and abs(splits["a"] - 500) < 10
    assert sampling.hash_split(df, "id", 100).filter("part = 'test'").count() in range(60, 140)
    assert sampling.weighted_draw(df, "id", "id", 10).count() == 10
    assert sampling.stratified_sample(df.limit(0), ["g"], "id", 10).count() == 0


def test_refill(spark):
    own = spark.createDataFrame([(1, "x", "s"), (2, "x", "s"), (3, "x", "s"), (4, "y", "t"), (5, "y", "t")], "id long, mark string, g string")
    pool = spark.createDataFrame([(10, "x", "s"), (11, "z", "s"), (12, "z", "s")], "id long, mark string, g string")
    assert rows(sampling.refill(own, pool, ["g"], "id", "mark")) == [(2, 11), (3, None), (5, None)]


def test_metrics(spark):
    got = metrics.group_spread(spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0), ("b", 1.0), ("c", 5.0)], "g string, v double"), "g", "v").first()
    assert (got.groups, got.mean_std, got.zero_rate) == (2, 0.25, 0.5)
    lengths = spark.createDataFrame([(1,), (2,), (10,), (None,)], "v int")
    assert {r.share: r.value for r in metrics.ceil_quantiles(lengths, "v", [0.5, 0.9, 1.0]).collect()} == {0.5: 2, 0.9: 10, 1.0: 10}
    assert rows(metrics.dense_histogram(spark.createDataFrame([(1,), (3,), (3,)], "v int"), "v")) == [(1, 1), (2, 0), (3, 2)]
    assert metrics.dense_histogram(lengths.limit(0), "v").count() == 0
    stats = metrics.length_summary(lengths, F.col("v")).first()
    assert (stats.min, stats.p50, stats.p90, stats.max, stats["mean"]) == (1, 2.0, 8.4, 10, 4.33)
    summary = metrics.numeric_summary(spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (3.0,)], "x double"), ["x"]).first()
    assert (summary.n, summary["mean"], summary["std"]) == (2, 2.0, 1.0)
    assert rows(metrics.categorical_rates(spark.createDataFrame([("a b",), (None,)], "x string"), "x")) == [("None", 0.5), ("a_b", 0.5)]


def test_evaluation(spark):
    schema = "reward double, reward_detail struct<r_type double, r_att double, r_option double, r_price double>, purchase_asin string, goal_asin string"
    df = spark.createDataFrame([(1.0, (1.0, 1.0, None, 1.0), "a", "a"), (0.5, (1.0, 0.5, 1.0, 1.0), "b", "a"), (0.0, None, None, "a")], schema)
    got = metrics.evaluation(df).first()
    assert (got.samples, got.done_rate, got.success, got.right_product, got.option) == (3, 0.6667, 0.3333, 0.3333, 0.6667)
    assert metrics.evaluation(df.limit(0)).first().samples == 0


CHAT = "用户：你好\n客服：在\nUser: \nAgent: ok\nnoise"


def test_conversations(spark):
    docs = spark.createDataFrame([(1, CHAT), (2, None), (3, ""), (4, "Agent: hi\nAgent: \"reward_detail\"")], "id long, text string")
    chats = conv.from_chat(docs, "id", "text")
    assert rows(chats.select("id", F.size("messages"))) == [(1, 4), (4, 2)]
    errors = {r.id: set(r.e) for r in chats.select("id", conv.order_errors(F.col("messages")).alias("e")).collect()}
    assert errors == {1: {"empty_content"}, 4: {"does_not_begin_with_user", "role_repeats"}}
    assert chats.filter("id = 1").select(conv.longest_prefix(F.col("messages"))).first()[0] == 3
    sample = conv.export(chats, "id").collect()
    assert [s.id for s in sample] == [1] and [m["content"] for m in json.loads(sample[0]["sample"])["messages"]] == ["你好", "在", "", "ok\nnoise"]
    mask = conv.label_masks(chats.filter("id = 1"), "id", 4).first()
    assert mask.labels == [-100, -100, ord("在"), ord("o"), -100, -100, -100, -100] and mask.attention_mask == [1] * 4 + [0] * 4
    assert mask.input_ids[:2] == [ord("你"), ord("好")]
    whole = conv.mask_stats(conv.label_masks(chats, "id", 2048)).first()
    assert whole.samples == 2 and whole.padded % 8 == 0


def test_catalog(spark):
    schema = "listing_id long, asin string, title string, brand string, category string, attributes array<string>"
    df = spark.createDataFrame([(1, "a1", " t ", None, "X", ["m", "", "n"]), (2, "nan", "t", "b", None, None), (3, None, "t", "b", None, None), (4, "x" * 21, "t", "b", None, None), (5, "a2", "t", " ", None, None)], schema)
    got = rows(catalog.clean(df))
    assert got == [(1, "a1", "t", "N.A.", "x", ["m", "n"]), (5, "a2", "t", "N.A.", "", [])]
    options = spark.createDataFrame([(1, {"Size": [(" A/B ", "i", 1.0)], "None": None})], "listing_id long, customization_options map<string, array<struct<value string, image string, price double>>>")
    assert rows(catalog.options(options)) == [(1, "size", 0, "a | b", "i")]
    a, b = (catalog.fingerprint(spark.range(3000).repartition(n).selectExpr("id", "cast(id AS string) t"), "id", "t").first() for n in (1, 7))
    assert a == b and a.rows == 3000


def test_terms(spark):
    df = spark.createDataFrame([("g", 1, "red cat"), ("g", 2, "red dog"), ("h", 3, "red")], "g string, id long, t string")
    top = {(r.id, r.place): r.token for r in catalog.top_terms(df, "g", "id", "t", k=1).collect()}
    assert top == {(1, 1): "cat", (2, 1): "dog", (3, 1): "red"}




def test_samplers(spark):
    rows_ = [(i, "hard" if i % 3 else "simple", f"d{i % 4}", "multi" if i % 2 else "single", f"m{i % 70}") for i in range(100)]
    df = spark.createDataFrame(rows_, "task_id long, difficulty string, domain string, option_bucket string, mark string")
    placed = sampling.in_key_order(df.withColumn("task_id", F.col("task_id") * 777), ["domain"], "task_id", "n")
    for d in range(4):
        assert [r.n for r in placed.filter(f"domain = 'd{d}'").orderBy("task_id").collect()] == list(range(1, 26))
    chosen = sampling.pilot(df, 10, "task_id").collect()
    assert {r.domain for r in chosen} == {"d0", "d1", "d2", "d3"} and sum(r.domain == "d3" and r.difficulty == "hard" and r.option_bucket == "multi" for r in chosen) >= 6
    with pytest.raises(ValueError):
        sampling.pilot(df, 3, "task_id")
    quotas = {"train": {"hard": 50, "simple": 30}, "validation": {"hard": 10}, "reserve": {"hard": 6, "simple": 4}}
    split = sampling.split_by_quotas(df, "difficulty", "task_id", quotas)
    counts = {(r.split, r.difficulty): r["count"] for r in split.groupBy("split", "difficulty").count().collect()}
    assert counts == {(s, d): n for s, q in quotas.items() for d, n in q.items()}
    for bad in ({"train": {"hard": 66}}, {"train": {"hard": 66, "simple": 33}}):
        with pytest.raises(ValueError):
            sampling.split_by_quotas(df, "difficulty", "task_id", bad)
    with pytest.raises(ValueError):
        sampling.split_by_quotas(df, "difficulty", "task_id", quotas, "mark")
    left = sampling.remaining(df, df.filter("task_id < 3"), "task_id", "mark")
    assert left.count() == 100 - 6 and left.filter("task_id IN (0, 70, 72)").count() == 0
    pool = spark.createDataFrame([(500, "hard", "d1", "multi", "new"), (501, "hard", "d1", "multi", "new"), (502, "simple", "d2", "single", "m1")], df.schema)
    got = {r.removed: r.added for r in sampling.refill(df, pool, ["difficulty", "domain", "option_bucket"], "task_id", "mark").collect()}
    assert set(got) == set(range(70, 100)) and [k for k, v in got.items() if v] == [min(k for k in got if k % 3 and k % 4 == 1)] and 500 in got.values()
    assert sampling.refill(df.limit(0), pool, ["domain"], "task_id", "mark").count() == 0


def test_running_counts(spark):
    r = random.Random(3)
    values = [r.choice([1, 2, 5, 1000, 10**9]) * r.randint(1, 9) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    got = {x.value: (x.n, x.upto) for x in metrics.running_counts(df, "v", 10).collect()}
    assert got == {v: (values.count(v), sum(x <= v for x in values)) for v in set(values)}
    assert metrics.running_counts(df.limit(0), "v").count() == 0
    one = spark.createDataFrame([(3,), (3,)], "v long")
    assert [tuple(x) for x in metrics.running_counts(one, "v").collect()] == [(3, 2, 2)]
    t = metrics.trained_totals(spark.createDataFrame([(10, 4), (20, 6)], "n int, t int"), "n", "t", 20).first()
    assert (t.samples, t.samples_at_max, t.tokens, t.trained, t.fraction) == (2, 1, 30, 10, 0.333333)


def test_terms_and_goals(spark):
    from trailmart.operators import goals

    docs = spark.createDataFrame([(1, "a", "red shoe red 12"), (2, "a", "the blue shoe"), (3, None, "x y"), (4, "a", None), (5, "a", "")], "id int, g string, t string")
    top = catalog.top_terms(docs, "g", "id", "t", stop_words=catalog.STOP_WORDS).collect()
    assert [(r.id, r.token) for r in sorted(top, key=lambda r: (r.id, r.place)) if r.g] == [(1, "red"), (1, "shoe"), (2, "blue"), (2, "shoe")]
    pairs = catalog.top_terms(docs, "g", "id", "t", ngrams=(2,), stop_words=catalog.STOP_WORDS).filter("g = 'a'").collect()
    assert {r.token for r in pairs} == {"red shoe", "shoe red", "blue shoe"}
    g = spark.createDataFrame([(7, "as", None, "n", '买 "x"', ["a"], ["o"])], "task_id int, asin string, category string, name string, instruction string, attributes array<string>, opts array<string>")
    goal = goals.goal(g, "task_id", options="opts")
    row = goals.training_row(goal, "sys").first()
    truth = json.loads(row.ground_truth)
    assert truth == {"task_id": 7, "goal": {"asin": "as", "category": "", "name": "n", "instruction_text": '买 "x"', "attributes": ["a"], "goal_options": ["o"]}}
    assert [m.role for m in row.prompt] == ["system", "user"] and row.prompt[1].content.endswith("可点击的按钮: []")
    payload = json.loads(goals.start_payload(goal, "task_id").first().payload)
    assert payload["idx"] == 7 and not payload["done"]
    many = spark.range(50).withColumnRenamed("id", "task_id")
    assert goals.chosen_goals(many, "task_id", lambda d: d.task_id % 2 == 0, 5).count() == 5 and goals.chosen_goals(many, "task_id").count() == 50
    assert one(spark, goals.observation_text(F.array(F.struct(F.lit("A").alias("text"), F.lit(True).alias("button")), F.struct(F.lit(" ").alias("text"), F.lit(False).alias("button"))), True)) == "[button] A [button_]"
    assert one(spark, F.map_keys(goals.without_weights(F.create_map(F.lit("w_x"), F.lit(1), F.lit("r"), F.lit(2))))) == ["r"]
    assert one(spark, goals.zip_rows(F.array(F.lit(1)), F.array(F.lit(2)), ("a", "b")))[0].b == 2 and one(spark, goals.zip_rows(F.array(F.lit(1)), F.array().cast("array<int>"), ("a", "b"))) is None
