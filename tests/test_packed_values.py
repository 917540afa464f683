import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmart.operators.packed_values import DELIMITERS, QUOTES, SPACES, split_buffers, split_packed


def slow(s):
    """The rules, one character at a time."""
    white = lambda c: c in SPACES + "\t\n\r"

    def delimiter(i):
        if s[i] in DELIMITERS:
            return 1
        if s[i] == ":" and (s[i + 1 : i + 2] == ":" or s[i - 1 : i] == ":"):
            return 1
        if s[i] == "-" and (i == 0 or white(s[i - 1])) and (i + 1 == len(s) or white(s[i + 1])):
            return 1
        return 0

    out, i = [], 0
    while i <= len(s):
        start = i
        while start < len(s) and white(s[start]) and not delimiter(start):
            start += 1
        j, close = start, -1
        if start < len(s) and s[start] in QUOTES:
            k = start + 1
            while k < len(s):
                if s[k] == QUOTES[s[start]]:
                    if s[start] == '"' and s[k + 1 : k + 2] == '"':
                        k += 2
                        continue
                    close = k
                    break
                k += 1
            j = close + 1 if close >= 0 else start + 1
        while j < len(s) and not delimiter(j):
            j += 1
        end = j
        while end > start and white(s[end - 1]):
            end -= 1
        value = s[start:end]
        if close >= 0 and close == end - 1:
            inner = value[1:-1]
            value = (inner.replace('""', '"') if s[start] == '"' else inner).strip(SPACES + "\t\n\r")
        if value:
            out.append(value)
        i = j + (delimiter(j) if j < len(s) else 1)
    return out


def test_examples():
    cases = {
        '『电脑、办公』›显示器 › 27" 显示器': ["电脑、办公", "显示器", '27" 显示器'],
        "a > b | c": ["a", "b", "c"],
        'x / """自营""专区; 精选" / y': ["x", '"自营"专区; 精选', "y"],
        '["a", "b,c", "b,c"]': ["a", "b,c", "b,c"],
        "家用 - 0-3岁 - T-恤": ["家用", "0-3岁", "T-恤"],
        "a::b::::c": ["a", "b", "c"],
        "Kid's Picks;'A/B'": ["Kid's Picks", "A/B"],
        "a\n\tb\t": ["a", "b"],
        "": [], "  ": [], ";": [], '""': [], " › ": [],
    }
    assert split_buffers(pa.array(list(cases))).to_pylist() == list(cases.values())


def test_null_empty_sliced_and_long():
    assert split_buffers(pa.array([None, "a,b", None, "c"])).to_pylist() == [[], ["a", "b"], [], ["c"]]
    assert split_buffers(pa.array([], pa.string())).to_pylist() == []
    assert split_buffers(pa.array(["x,y", "a,b", "c"]).slice(1)).to_pylist() == [["a", "b"], ["c"]]
    long = ",".join(f'"v;{i}"' for i in range(20000))
    assert split_buffers(pa.array([long, "z"])).to_pylist() == [[f"v;{i}" for i in range(20000)], ["z"]]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='ab茶 -:"\'“”,›\t𠮷', max_size=14), max_size=6))
def test_against_slow(texts):
    assert split_buffers(pa.array(texts, pa.string())).to_pylist() == [slow(t) for t in texts]


def test_many_rows_against_slow():
    r = random.Random(3)
    texts = ["".join(r.choices('ab茶咖 -:"“”『』›/,|\t', k=r.randint(0, 30))) for _ in range(5000)]
    assert split_buffers(pa.array(texts)).to_pylist() == [slow(t) for t in texts]


def test_rows_keep_ids_and_positions(spark):
    df = spark.createDataFrame([(1, "a>b", "e"), (2, None, "e"), (3, "", "f"), (4, "c", None)], "id long, category string, extra string")
    got = split_packed(df, "category", ["id", "extra"]).collect()
    assert [tuple(r) for r in got] == [(1, "e", 0, "a"), (1, "e", 1, "b"), (4, None, 0, "c")]
    assert split_packed(df.filter("id > 9"), "category", ["id"]).count() == 0
    # an extra column whose name clashes with the value's is not in the way
    clash = df.withColumnRenamed("extra", "segment")
    assert split_packed(clash, "category", ["id"]).count() == 3


def test_batches_are_cut_by_bytes_and_nothing_is_lost():
    import pyarrow as pa

    from trailmart.sources.tables import byte_slices

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "", "b" * 50, "c" * 5, "d" * 5])], names=["k", "t"])
    parts = list(byte_slices(batch, 1, 12))
    assert [p.num_rows for p in parts] == [3, 1, 2] and [x for p in parts for x in p.column(1).to_pylist()] == batch.column(1).to_pylist()
    assert list(byte_slices(batch.slice(0, 0), 1)) == []
