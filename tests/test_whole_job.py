"""Queries count whole inputs, where an earlier form cut or dropped some."""

from trailmart.operators import conversations as conv


def test_masks_of_long_chats_are_whole(spark):
    docs = spark.createDataFrame([(1, "User: " + "a" * 9000 + "\nAgent: " + "b" * 500), (2, "User: hi\nAgent: 😀茶"), (3, "User: x")], "id long, text string")
    got = conv.mask_totals(conv.label_masks(conv.from_chat(docs, "id", "text"), "id"), 8192).first().asDict()
    assert got == {"samples": 3, "trained": 502, "tokens": 9505, "padded": 9504 + 8 + 8, "samples_over": 1, "tokens_over": 1308, "fraction": round(502 / 9505, 6)}


def test_tags_in_any_writing_and_all_held_out_splits(spark, tmp_path):
    from trailmart.plans import catalog

    data = [
        (1, "train", "a", "Red cup"), (2, "Train", "a", "blue cup"), (3, "train\n", "a", "green cup"), (4, " train", "a", "x"), (5, "TRAIN", "a", "y"), (6, "reserve", "backfill", "z"), (7, "Train", "backfill", "q"),
        (8, "EVAL", "a", "red-cup"), (9, "online_dev ", "a", "BLUE cup"), (10, "test", "a", "green cup!"), (11, " Train", "a", "Y"),
    ]
    spark.createDataFrame([(*r, "d", "hard", "multi") for r in data], "task_id long, tag string, source string, instruction string, domain string, difficulty string, option_bucket string").write.parquet(str(tmp_path / "tasks.parquet"))
    assert sorted(r.task_id for r in catalog.unseen_train(spark, str(tmp_path)).collect()) == [4, 5, 7, 11]
    assert [(r.removed, r.added) for r in catalog.dedup_refill(spark, str(tmp_path)).collect()] == [(11, 6)]


def test_long_rollouts_are_in_the_overflow_bin(spark, tmp_path):
    from trailmart.plans import evaluation

    data = [(str(i), ({"num_tool_calls": v},)) for i, v in enumerate([998.0, 999.0, 1000.0, 5e9, float("inf"), float("nan"), -1.0])]
    spark.createDataFrame(data, "record_id string, verification struct<metrics: map<string, double>>").write.parquet(str(tmp_path / "rollouts.parquet"))
    assert sorted((r.value, r.n) for r in evaluation.step_histogram(spark, str(tmp_path)).collect()) == [(998, 1), (999, 1), (1000, 2)]


def test_a_pilot_of_more_domains_than_tasks(spark, tmp_path):
    import duckdb

    from trailmart.plans import catalog

    spark.range(400).selectExpr("id AS task_id", "concat('d', id % 71) AS domain", "'hard' AS difficulty", "'multi' AS option_bucket").coalesce(1).write.parquet(str(tmp_path / "tasks.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW tasks AS SELECT * FROM read_parquet('{tmp_path}/tasks.parquet/*.parquet')")
    wanted = con.execute(catalog.ORACLES["pilot_choice"]).fetchall()
    assert len(wanted) == 60 and sorted(wanted) == sorted((r.task_id, r.domain) for r in catalog.pilot_choice(spark, str(tmp_path)).collect())
