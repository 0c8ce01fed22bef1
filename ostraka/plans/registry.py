"""All registered queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import analytics, bibliography, catalogue, jobs, lookups_by_input, records, search, transliterations, versions  # noqa: F401  they register their queries
from .base import QUERIES, SQL as ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["lemma_and"](spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
