"""One written form for texts that look the same.

Every Arrow batch of a partition is registered in an in-process DuckDB, where embedded SQL
with ``translate``, ``replace``, ``regexp_replace`` and ``nfc_normalize`` maps

* invisible characters to nothing, every kind of space to a plain space,
* full-width and half-width forms, radicals, ligatures and Roman numeral signs to plain characters,
* letters that a reader cannot tell apart (Cyrillic, Greek) to the Latin ones,
* composed and decomposed accents to the composed form.

Case, accents, simplified and traditional characters, raised digits and different signs keep
their difference. Null stays null; an empty text, or one of invisible characters only, gives ''.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import table
from ..sources.tables import cut

# Letters of other scripts that look like Latin ones, each followed by its twin.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХԌԚԜҮаеѕіјорсухһԁԛԝӏѵёїѐЁЇЀ", "ABESIJKMHOPCTYXGQWYaesijopcyxhdqwlvëïèËÏÈ")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳϲνορόΆΈΌΊΎ", "ABEZHIKMNOPTYXCjcvopóÁÉÓÍÝ")
OTHER = ("ՍօհցᎪᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃᏴᏟᎠᏀɡ", "UohgAEHJKLMPSTVWZBCDGg")
HYPHENS = ("‐‑", "--")
SPACES = "               　\t"
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}]"
#: The same for Python.
INVISIBLE_PATTERN = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m.group(1), 16)), INVISIBLE))
#: Texts of these characters only are in the one form already.
ORDINARY = "[ -~\\x{3001}-\\x{3029}\\x{4E00}-\\x{9FFF}]*"
#: Blocks whose characters are other writings of plain ones: full width; Roman numerals, radicals, ligatures, half width, letter-like digits, units in one character, letters of rarer scripts.
WIDE_BLOCK = (0xFF01, 0xFF5F)
RARE_BLOCKS = [(0x261, 0x262), (0x530, 0x590), (0x13A0, 0x13F6), (0x2103, 0x2104), (0x2109, 0x210A), (0x2160, 0x2180), (0x3371, 0x33E0), (0x2E80, 0x2FE0), (0xFB00, 0xFB07), (0xFF5F, 0xFFE7), (0x1D400, 0x1D800)]


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _plain(c: str) -> str:
    """The compatibility form of a character; units in one character keep their raised digits."""
    kind, *parts = unicodedata.decomposition(c).split(" ")
    return "".join(chr(int(x, 16)) for x in parts) if kind == "<square>" else unicodedata.normalize("NFKC", c)


def _mapped(blocks: list[tuple[int, int]], start: str) -> str:
    """SQL that maps the characters of the blocks, and the twins, in ``start``."""
    one = dict.fromkeys(SPACES, " ")
    for left, right in (CYRILLIC, GREEK, HYPHENS, *([OTHER] if len(blocks) > 1 else [])):
        one |= dict(zip(left, right, strict=True))
    for low, high in blocks:
        for c in map(chr, range(low, high)):
            plain = _plain(c)
            if len(plain) == 1 and plain != c:
                one[c] = one.get(plain, plain)
            elif len(plain) > 1 and " " not in plain:
                start = f"replace({start}, {_text(c)}, {_text(plain)})"
    return f"nfc_normalize(translate({start}, {_text(''.join(one))}, {_text(''.join(one.values()))}))"


def macro_sql() -> str:
    """The macro ``one_form(s)`` as DuckDB SQL.

    ``translate`` costs in proportion to its map, so texts get the smallest of three that serves:
    none, full width with look-alikes, or all blocks.
    """
    seen = f"regexp_replace(s, {_text(INVISIBLE)}, '', 'g')"
    rare = "[" + "".join(f"\\x{{{low:X}}}-\\x{{{high - 1:X}}}" for low, high in RARE_BLOCKS) + "]"
    return (
        f"CREATE MACRO one_form(s) AS CASE WHEN regexp_full_match(s, {_text(ORDINARY)}) THEN s "
        f"WHEN regexp_matches(s, {_text(rare)}) THEN {_mapped([WIDE_BLOCK, *RARE_BLOCKS], seen)} ELSE {_mapped([WIDE_BLOCK], seen)} END"
    )


def _connect():
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB"})
    con.execute(macro_sql())
    return con


def in_duckdb(df: DataFrame, sql: str, schema: T.StructType | str) -> DataFrame:
    """Run ``sql`` over each Arrow batch, there named ``batch``; the macro ``one_form`` is at hand.

    The SQL sees one batch at a time, so it may only hold row-wise work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        for rows in batches:
            con.register("batch", pa.Table.from_batches([rows]))
            yield from con.sql(sql).to_arrow_table().to_batches()
            con.unregister("batch")
        con.close()

    return df.mapInArrow(run, schema)


def with_one_form(df: DataFrame, column: str, keep: Sequence[str], name: str = "one_form") -> DataFrame:
    """The ``keep`` columns, ``column`` and its one form under ``name``."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(column, T.StringType()), T.StructField(name, T.StringType())])
    picked = ", ".join(f'"{c}"' for c in [*keep, column])
    return in_duckdb(df.select(*keep, column), f'SELECT {picked}, one_form("{column}") AS "{name}" FROM batch', schema)


def lookalike_pairs(df: DataFrame, key: str, column: str) -> DataFrame:
    """Pairs (id_a, id_b) of keys whose texts look the same and are different strings.

    Equal strings are one class: classes of a form are paired first and expanded last, so the
    cost follows the result, not the square of a hot text. Null texts are in no pair.
    """
    formed = with_one_form(df.select(key, column).filter(F.col(column).isNotNull()).distinct(), column, [key])
    formed = cut(formed.select(F.col(key).alias("id"), F.col(column).alias("text"), "one_form"))
    varied = formed.groupBy("one_form").agg(F.min("text").alias("low"), F.max("text").alias("high")).filter("low <> high").select("one_form")
    hits = formed.join(varied, "one_form", "left_semi")
    classes = hits.select("one_form", "text").distinct()
    pairs = classes.select("one_form", F.col("text").alias("text_a")).join(classes.select("one_form", F.col("text").alias("text_b")), "one_form").filter("text_a < text_b")
    left = hits.select("one_form", F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = hits.select("one_form", F.col("id").alias("b"), F.col("text").alias("text_b"))
    found = pairs.join(left, ["one_form", "text_a"]).join(right, ["one_form", "text_b"])
    return found.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def lookalike_options(rollouts: DataFrame) -> DataFrame:
    """(id_a, id_b): record and place of each wanted option that no bought option equals but one looks like.

    Row-local, so there is no shuffle but that of the few found rows. Null options, and records
    without a goal or purchase, give no rows.
    """
    bought = F.filter(F.map_values("purchase.options"), lambda v: v.isNotNull())
    rows = rollouts.select(F.col("record_id").alias("id"), F.col("goal.goal_options").alias("wanted"), bought.alias("bought"))
    rows = rows.filter("size(bought) > 0 AND exists(wanted, o -> o IS NOT NULL AND NOT array_contains(bought, o))")
    sql = """
        WITH wanted_options AS (
            SELECT id, bought, unnest(wanted) AS wanted, generate_subscripts(wanted, 1) - 1 AS place FROM batch
        ), missing AS (
            SELECT * FROM wanted_options WHERE wanted IS NOT NULL AND NOT list_contains(bought, wanted)
        )
        SELECT id AS id_a, place::BIGINT AS id_b FROM missing
        WHERE list_contains(list_transform(bought, lambda v: one_form(v)), one_form(wanted))
    """
    return in_duckdb(rows, sql, "id_a long, id_b long").distinct()


def p5_found(spark, sf_dir: str) -> DataFrame:
    titles = lookalike_pairs(table(spark, sf_dir, "products", "listing_id", "title"), "listing_id", "title")
    options = lookalike_options(table(spark, sf_dir, "rollouts", "record_id", "goal", "purchase"))
    return titles.select(F.lit("title").alias("field"), "id_a", "id_b").unionByName(options.select(F.lit("options").alias("field"), "id_a", "id_b"))


def p5_titles(spark, sf_dir: str) -> DataFrame:
    """Every listing's title beside its one form."""
    return with_one_form(table(spark, sf_dir, "products", "listing_id", "title").distinct(), "title", ["listing_id"])


QUERIES = {"p5_found": p5_found, "p5_titles": p5_titles}
