"""Queries on fields that pack several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.packed_values import split_packed
from ..sources import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each listing's category path, with their places.

    A redelivered listing counts once; the rows are told apart before the split, on the two columns that are read.
    """
    listings = table(spark, sf_dir, "products", "listing_id", "category").filter("category IS NOT NULL AND listing_id IS NOT NULL")
    return split_packed(listings.distinct(), "category", ["listing_id"])


QUERIES = {"p1_found": p1_found}
ORACLES: dict[str, str] = {}
