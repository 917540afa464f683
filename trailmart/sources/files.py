"""JSON sources and sinks, manifests, and versioned index folders.

All paths may be local or in any file system that Spark reads. Only manifests, a few lines each, pass through the driver.
"""

from __future__ import annotations

import json
import math
import os
import tempfile
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_broken"

PRODUCT = """asin STRING, title STRING, shop_name STRING, brand STRING, category STRING, attribute ARRAY<STRING>,
    customization_options MAP<STRING, ARRAY<STRUCT<value: STRING, image: STRING, price: DOUBLE>>>, pricing ARRAY<DOUBLE>, tag STRING"""
MESSAGE = "STRUCT<role: STRING, content: STRING, reasoning_content: STRING, tool_call_id: STRING, tool_calls: ARRAY<STRUCT<id: STRING, type: STRING, function: STRUCT<name: STRING, arguments: STRING>>>>"
TRAJECTORY = f"task_id BIGINT, reward DOUBLE, reward_detail STRUCT<r_att: DOUBLE, r_option: DOUBLE, r_price: DOUBLE, r_type: DOUBLE>, conversation ARRAY<{MESSAGE}>"


def _with_broken(schema: str) -> T.StructType:
    return T.StructType.fromDDL(f"{schema}, {BROKEN} STRING")


def read_catalog(spark: SparkSession, path: str, schema: str = PRODUCT, head: int | None = None) -> DataFrame:
    """A JSON array (or several files of them) as rows with ``ordinal``, the place in the array; with ``head`` only the first ones.

    The text of a file is one value, as the array's order is its meaning; catalogues to be split are given as several files.
    """
    raw = spark.read.option("wholetext", True).text(path).select(F.col("value"), F.col("_metadata.file_name").alias("file"))
    rows = raw.select("file", F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("ordinal", "row")).select("file", "ordinal", "row.*")
    return rows if head is None else rows.filter(F.col("ordinal") < head)


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines: the good rows, and the broken lines as they are."""
    parsed = spark.read.text(path).select(F.col("value"), F.from_json("value", _with_broken(schema), {"columnNameOfCorruptRecord": BROKEN}).alias("row"))
    blank = F.trim("value") == ""
    bad = F.col("row").isNull() | F.col(f"row.{BROKEN}").isNotNull()
    return parsed.filter(~blank & ~bad).select("row.*").drop(BROKEN), parsed.filter(~blank & bad).select("value")


def read_required_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of which each must be an object, and one at least must be there; anything else is an error."""
    good, broken = read_lines(spark, path, schema)
    if not broken.isEmpty() or good.isEmpty():
        raise ValueError(f"{path} is empty or has lines that are no JSON objects")
    return good


def by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, for lookups; a join with it leaves out keys that are not there."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*(c for c in rows.columns if c != key)), order).alias("_row")).select(key, "_row.*")


def read_config(path: str, known: Mapping[str, object]) -> dict:
    """A JSON settings file over its defaults; unknown names are an error."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if not isinstance(given, dict) or (unknown := sorted(set(given) - set(known))):
        raise ValueError(f"settings must be an object of known names: {unknown if isinstance(given, dict) else given}")
    return dict(known) | given


def quota_errors(sizes: Mapping[str, int], quotas: Mapping[str, Mapping[str, int]], whole: Mapping[str, int]) -> list[str]:
    """Where sizes of splits differ from their quotas, or all quotas of a label from what there is of it."""
    out = [f"{k}: {n} is not {sum(quotas.get(k, {}).values())}" for k, n in sizes.items() if n != sum(quotas.get(k, {}).values())]
    return out + [f"{v}: {n} is not {sum(q.get(v, 0) for q in quotas.values())}" for v, n in whole.items() if n != sum(q.get(v, 0) for q in quotas.values())]


def read_folder(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """One JSON object per file, top level only: rows with ``file``, and the names of the unreadable files."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", False).option("pathGlobFilter", "*.json").text(folder)
    parsed = raw.select(F.col("_metadata.file_name").alias("file"), F.from_json("value", _with_broken(schema), {"columnNameOfCorruptRecord": BROKEN}).alias("row"))
    bad = F.col("row").isNull() | F.col(f"row.{BROKEN}").isNotNull()
    return parsed.filter(~bad).select("file", "row.*").drop(BROKEN), parsed.filter(bad).select("file")


def finished_ids(folder_rows: DataFrame) -> DataFrame:
    """Ids of the files whose name is a whole number."""
    return folder_rows.select(F.expr(r"try_cast(regexp_extract(file, '^([0-9]+)\\.json$', 1) AS bigint)").alias("task_id")).filter("task_id IS NOT NULL").distinct()


def paired(left: DataFrame, right: DataFrame, key: str, agree: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join of two folders' rows with ``state``: both, left only, right only, or differs where a column of ``agree`` does."""
    a, b = left.withColumn("_l", F.lit(True)), right.select(key, *(F.col(c).alias(f"_r_{c}") if c in agree else F.col(c) for c in right.columns if c != key), F.lit(True).alias("_r"))
    differs = F.lit(False)
    for c in agree:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    state = F.when(F.col("_l").isNull(), "right only").when(F.col("_r").isNull(), "left only").when(differs, "differs").otherwise("both")
    return a.join(b, key, "full_outer").withColumn("state", state).drop("_l", "_r", *(f"_r_{c}" for c in agree))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of whole numbers, each once; anything else is an error."""
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "array<string>")).alias("v"))
    ids = rows.select(F.expr("try_cast(v AS bigint)").alias("task_id"))
    n = ids.agg(F.count("*").alias("all"), F.count("task_id").alias("good"), F.countDistinct("task_id").alias("own")).first()
    if n["all"] != n["good"] or n["good"] != n["own"]:
        raise ValueError("ids must be whole numbers, each once")
    return ids


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_text(path: str, text: str) -> None:
    """A small local file, complete or not there at all."""
    handle, part = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def row_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): the same for the same rows in any order, on any cluster."""
    each = F.xxhash64(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(each.cast("decimal(38,0)")).cast("string"), F.lit("0")).alias("digest"))


def write_metrics(path: str, metrics: Mapping[str, object]) -> None:
    """Numbers of a run as one JSON file; not a number and infinite become null."""
    plain = {k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in metrics.items()}
    write_text(path, json.dumps(plain, ensure_ascii=False, indent=2, sort_keys=True))


def write_once(path: str, value: object) -> None:
    """A JSON file that stays as it was first written; another value for it is an error."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if json.load(f) != value:
                raise ValueError(f"{path} holds something else")
        return
    write_text(path, json.dumps(value, ensure_ascii=False))


def write_report(path: str, title: str, facts: Mapping[str, object], tables: Mapping[str, DataFrame], most: int = 1000) -> None:
    """A Markdown page of facts and small tables; a table of more than ``most`` rows is an error."""
    lines = [f"# {title}", "", *(f"- {k}: {v}" for k, v in facts.items())]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} is too long for a report")
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows)]
    write_text(path, "\n".join([*lines, ""]))


def write_by_key(df: DataFrame, folder: str, key: str) -> None:
    """Rows as JSON lines in a folder per key (a session, a run), as many tasks as Spark makes; existing folders are kept."""
    df.write.mode("append").partitionBy(key).option("ignoreNullFields", False).json(folder)


def write_pairs(trajectories: DataFrame, diagnostics: DataFrame, folder: str, run: str) -> None:
    """Trajectories and diagnostics of a run side by side; a run is written once."""
    for name, df in (("trajectories", trajectories), ("diagnostics", diagnostics)):
        write_lines(df, f"{folder}/{name}/run={run}")


def write_training_set(splits: Mapping[str, DataFrame], excluded: Mapping[str, list], folder: str, about: Mapping[str, object]) -> dict:
    """Splits as Parquet in a new version of a folder; the manifest has their digests and what was left out of each."""
    return write_versioned(splits, folder, dict(about) | {"excluded": {k: sorted(v) for k, v in excluded.items()}})


def write_versioned(tables: Mapping[str, DataFrame], folder: str, about: Mapping[str, object]) -> dict:
    """Tables as Parquet in a new version of the folder; its manifest is written last and makes it the current one.

    A version belongs to the writer that made its folder, so of two at once one goes on to the next number.
    """
    spark = next(iter(tables.values())).sparkSession
    version = max((int(v) for v in _names(spark, folder) if v.isdigit()), default=0) + 1
    while not _claim(spark, f"{folder}/{version}"):
        version += 1
    manifest = dict(about) | {"version": version, "tables": {}}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
        own = row_digest(spark.read.parquet(f"{folder}/{version}/{name}")).first()
        manifest["tables"][name] = {"rows": own["rows"], "digest": own["digest"]}
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/{version}/manifest")
    return manifest


def _claim(spark: SparkSession, folder: str) -> bool:
    """Make the mark of a new version; False if another writer has made it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_writer")
    try:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False).close()
    except Py4JJavaError:
        return False
    return True


def open_versioned(spark: SparkSession, folder: str, expected: Mapping[str, object]) -> dict[str, DataFrame] | None:
    """The tables of the newest complete version whose manifest says what is expected, else None: build anew."""
    for version in sorted((int(v) for v in _names(spark, folder) if v.isdigit()), reverse=True):
        if "manifest" not in _names(spark, f"{folder}/{version}"):
            continue
        manifest = json.loads(spark.read.text(f"{folder}/{version}/manifest").first()["value"])
        if all(manifest.get(k) == v for k, v in expected.items()):
            return {name: spark.read.parquet(f"{folder}/{version}/{name}") for name in manifest["tables"]}
        return None
    return None


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
