import datetime as dt
import json

import pytest

from conftest import rows
from trailmart.sources import files
from trailmart.streaming import events as ev


def test_catalogue_array(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"asin": "a", "attribute": ["x"], "customization_options": {"s": None}}, {"asin": "b", "unknown": 1}, {}]))
    got = files.read_catalog(spark, str(path))
    assert [(r.ordinal, r.asin) for r in got.orderBy("ordinal").collect()] == [(0, "a"), (1, "b"), (2, None)]
    assert files.read_catalog(spark, str(path), head=1).count() == 1


def test_lines_and_folders(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"task_id": 1, "reward": 1.0}\n\nnot json\n{"task_id": 2}\n')
    good, bad = files.read_lines(spark, str(tmp_path / "l.jsonl"), "task_id BIGINT, reward DOUBLE")
    assert rows(good) == [(1, 1.0), (2, None)] and rows(bad) == [("not json",)]
    folder = tmp_path / "runs"
    (folder / "deep").mkdir(parents=True)
    for name, text in {"1.json": '{"task_id": 1}', "x.json": '{"task_id": 9}', "2.json": "broken", "3.txt": "{}", "deep/4.json": "{}"}.items():
        (folder / name).write_text(text)
    good, bad = files.read_folder(spark, str(folder), "task_id BIGINT")
    assert rows(good) == [("1.json", 1), ("x.json", 9)] and rows(bad) == [("2.json",)]
    assert rows(files.finished_ids(good)) == [(1,)]
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "id int, l string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, r string")
    assert {r.id: r.state for r in files.paired(left, right, "id").collect()} == {1: "left only", 2: "both", 3: "right only"}


def test_ids(spark, tmp_path):
    path = tmp_path / "ids.json"
    for text, good in (("[3, 1]", True), ("[1, 1]", False), ('["x"]', False)):
        path.write_text(text)
        if good:
            assert rows(files.read_ids(spark, str(path))) == [(1,), (3,)]
        else:
            with pytest.raises(ValueError):
                files.read_ids(spark, str(path))


def test_versions(spark, tmp_path):
    df = spark.range(10).toDF("id")
    folder = str(tmp_path / "index")
    assert files.open_versioned(spark, folder, {}) is None
    assert files.write_versioned({"t": df}, folder, {"schema": 1})["version"] == 1
    assert files.write_versioned({"t": df.limit(3)}, folder, {"schema": 2})["version"] == 2
    assert files.open_versioned(spark, folder, {"schema": 2})["t"].count() == 3
    assert files.open_versioned(spark, folder, {"schema": 9}) is None
    assert files.row_digest(df).first() == files.row_digest(df.repartition(3)).first()
    files.write_text(str(tmp_path / "a.txt"), "x")
    assert (tmp_path / "a.txt").read_text() == "x"


def test_streams_equal_batches(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    data = [(i, t0 + dt.timedelta(minutes=7 * i + (45 if i % 5 == 0 else 0)), i % 3, "click" if i % 4 else "view", float(i), '{"k": 1}' if i % 2 else None) for i in range(60)]
    spark.createDataFrame(data, ev.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: ev.read_stream(spark, str(tmp_path / "in"), "*.parquet")
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert rows(ev.run_to_table(ev.hourly(stream()), "complete")) == rows(ev.hourly(batch))
    sessions = rows(ev.sessions(batch))
    closed = rows(ev.run_to_table(ev.sessions(stream())))
    assert closed and set(closed) <= set(sessions)
    repeats = {r.event_id: r.repeat for r in ev.run_to_table(ev.repeats_stream(stream())).collect()}
    last, expected = {}, {}
    for i, _, user, kind, _, props in sorted(data, key=lambda d: (d[1], d[0])):
        expected[i] = last.get(user) == (kind, props)
        last[user] = (kind, props)
    assert repeats == expected


def test_settings_reports_and_once(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": 2}')
    assert files.read_config(str(tmp_path / "c.json"), {"a": 1, "b": 3}) == {"a": 2, "b": 3}
    with pytest.raises(ValueError):
        files.read_config(str(tmp_path / "c.json"), {"b": 3})
    assert files.quota_errors({"train": 3}, {"train": {"x": 2, "y": 1}}, {"x": 2, "y": 1}) == [] and len(files.quota_errors({"train": 4}, {"train": {"x": 2}}, {"x": 3})) == 2
    files.write_once(str(tmp_path / "m.json"), [1, 2])
    files.write_once(str(tmp_path / "m.json"), [1, 2])
    with pytest.raises(ValueError):
        files.write_once(str(tmp_path / "m.json"), [1])
    files.write_metrics(str(tmp_path / "n.json"), {"x": float("nan"), "y": 1})
    assert json.loads((tmp_path / "n.json").read_text()) == {"x": None, "y": 1}
    files.write_report(str(tmp_path / "r.md"), "Pilot", {"tasks": 2}, {"Reasons": spark.createDataFrame([("a|b", 1)], "reason string, n int")})
    assert "| a\\|b | 1 |" in (tmp_path / "r.md").read_text()
    with pytest.raises(ValueError):
        files.write_report(str(tmp_path / "r.md"), "x", {}, {"t": spark.range(5)}, 4)
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n[1]\n')
    (tmp_path / "no.jsonl").write_text("\n")
    for name in ("bad", "no"):
        with pytest.raises(ValueError):
            files.read_required_lines(spark, str(tmp_path / f"{name}.jsonl"), "a int")


def test_pairs_sessions_and_lookups(spark, tmp_path):
    left = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 1.0)], "task_id int, reward double")
    right = spark.createDataFrame([(1, 0.5, "x"), (2, 0.0, "y"), (4, 1.0, "z")], "task_id int, reward double, why string")
    got = {r.task_id: r.state for r in files.paired(left, right, "task_id", ("reward",)).collect()}
    assert got == {1: "both", 2: "differs", 3: "left only", 4: "right only"}
    files.write_pairs(left, right, str(tmp_path / "p"), "r1")
    assert spark.read.json(str(tmp_path / "p" / "trajectories")).count() == 3
    files.write_by_key(right, str(tmp_path / "s"), "task_id")
    assert (tmp_path / "s" / "task_id=4").is_dir()
    rows_ = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), (None, 0, "x")], "asin string, n int, title string")
    assert [tuple(r) for r in files.by_key(rows_, "asin", "n").collect()] == [("a", 1, "first")]
    done = files.write_training_set({"train": left}, {"train": [9, 3]}, str(tmp_path / "t"), {"seed": 1})
    again = files.write_training_set({"train": left}, {"train": []}, str(tmp_path / "t"), {"seed": 1})
    assert done["excluded"]["train"] == [3, 9] and again["version"] == done["version"] + 1


def test_stored_index_and_pages(spark, tmp_path):
    from trailmart.functions import html
    from trailmart.operators import search

    docs = spark.createDataFrame([(1, "red cup"), (2, "blue cup"), (3, None)], "id int, title string")
    index = search.build_index(docs, "id", {"title": 3.0})
    about = {"fields": {"title": 3.0}, "fingerprint": "x"}
    assert search.open_index(spark, str(tmp_path / "i"), about) is None
    search.save_index(index, str(tmp_path / "i"), about)
    stored = search.open_index(spark, str(tmp_path / "i"), about)
    asked = spark.createDataFrame([(9, "red")], "q int, t string")
    assert [tuple(r) for r in search.search(stored, asked, "q", "t").collect()] == [tuple(r) for r in search.search(index, asked, "q", "t").collect()] != []
    assert search.open_index(spark, str(tmp_path / "i"), about | {"fingerprint": "y"}) is None
    with pytest.raises(ValueError):
        search.build_index(docs, "id", {"brand": 1.0})
    hits = spark.createDataFrame([(1, d, d) for d in range(1, 31)], "query int, doc int, rank int")
    moved = {r.doc: r.rank for r in search.shuffled_first(hits, 10).collect()}
    assert sorted(moved[d] for d in range(1, 11)) == list(range(1, 11)) and all(moved[d] == d for d in range(11, 31))
    page = "<html><h1> Red <b>cup</b></h1><span class='x-price'>US $5</span><select name='Size:'><option>- Select -</option><option>S</option><option>M</option></select><ul><li>Big<li>Light</ul>"
    got = html.html_products(spark.createDataFrame([(1, page), (2, None)], "id int, html string"), "id", "html").collect()
    assert (got[0].title, got[0].price, got[0].features, got[0].options) == ("Red", "US $5", ["Big", "Light"], {"Size": ["S", "M"]}) and got[1].title == ""
    assert html.button_of({" Buy Now ": "u"}, "buy now") == "u" and html.button_of({}, "x") is None
