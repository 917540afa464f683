"""Access to the Parquet tables of a data folder."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of the folder; with ``columns`` only these are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, factor: int = 1) -> DataFrame:
    """Give a small input at least one partition per core before Python-bound work.

    An input that already has that many partitions is returned untouched, so a large
    scan never pays a shuffle for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * factor)


def byte_slices(batch: pa.RecordBatch, column: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in a text column, or one row; nothing is copied or shortened."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's own setting, else a local default."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(configured)
        return configured
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(os.path.join("/tmp", "trailmart-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that it is computed once and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
