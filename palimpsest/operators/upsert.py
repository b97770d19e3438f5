"""Replacing rows by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key, columns matched by name.

    Columns that ``new`` lacks become null in its rows. Only the keys of ``new`` are shuffled against ``old``.
    """
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti").select(old.columns)
    return kept.unionByName(new, allowMissingColumns=True).select(old.columns)


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
