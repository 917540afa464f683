import numpy as np

from trailmart.llm import abuse


def test_whole_windows_are_learnt_and_rows_may_share_a_key(spark):
    long = "好" * 3000 + "茶白痴"
    texts = spark.createDataFrame([(1, long)] * 50, "doc_id long, text string")
    read = abuse.read_windows(texts, 10_000)
    own = abuse.windows([long])
    assert abuse.pattern_counts(read) == {int(own.votes()[0]): 50}
    assert [(list(f), b, n) for f, b, n in abuse.sample_windows(read, 10_000)] == [(sorted(own.bucket), int(own.votes()[0]), 50.0)]
    assert set(abuse.windows(["茶白痴"]).bucket) <= set(own.bucket)
    keyless = spark.createDataFrame([(None, f"{chr(0x5000 + i)}的白痴") for i in range(400)], "doc_id long, text string")
    drawn = abuse.sample_windows(abuse.read_windows(keyless, 40), 40)
    assert len(drawn) == 40 and abs(sum(w for _, _, w in drawn) - 400) < 200
    assert abuse.sample_windows(abuse.read_windows(keyless.limit(0), 40), 40) == []


def test_a_task_with_more_windows_than_others_biases_no_sample():
    """Tasks that keep too few windows lower the share of all."""
    kept = abuse.Sample({True: 20, False: 20})
    own = abuse.windows([f"{chr(0x5000 + i)}的白痴" for i in range(300)])
    drawn = np.random.default_rng(1).random(len(own.text))
    kept.add(own, own.votes(), drawn)
    assert len(kept.rows[True]) == 20 and kept.below[True] == np.sort(drawn)[20] and all(r[0] < kept.below[True] for r in kept.rows[True])
    kept.add(own, own.votes(), drawn + kept.below[True])
    assert len(kept.rows[True]) == 20 and kept.below[False] == 1.0 and not kept.rows[False]


def test_training_does_not_depend_on_the_number_of_rows():
    rows = [(np.array([1, 2]), 1, 1.0, 1.0), (np.array([2, 3]), 0, 0.0, 5.0), (np.array([3]), 0, 0.0, 4.0)]
    (w, b), (w_many, b_many) = abuse.train(rows), abuse.train([(f, v, y, n * 1e4) for f, v, y, n in rows])
    assert np.allclose(w, w_many) and abs(b - b_many) < 1e-6
