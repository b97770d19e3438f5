"""Ranks that do not need all rows of a group in one task.

Rows are first counted by distinct value. Distinct values of a group fall into as many
buckets as it takes for each to hold about ROWS, by the group's own approximate quantiles;
running counts are taken within a bucket, and the buckets' totals, a small table, give each
its offset. A group that is known to have no more than ROWS rows is sorted as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep

#: Rows, or distinct values, that are ranked in one task.
ROWS = 250_000


def value_counts(df: DataFrame, keys: list[str], value: str, rows: int = ROWS, **sums: Column) -> DataFrame:
    """Per distinct non-null ``value``: ``n`` rows with it and ``before``, rows with a lesser one, by ``keys``.

    ``sums`` are further columns to total per value. NaN counts as the largest value. Null
    keys are a group of their own.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))
    counted = keep(counted)  # read for the sizes, the cuts and the ranks
    bucketed, n = in_buckets(counted, keys, value, rows)
    inner = Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = bucketed.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    if n > 1:
        totals = bucketed.groupBy(*keys, "__bucket").agg(F.sum("n").alias("__m"))
        earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*keys, "__bucket", F.coalesce(F.sum("__m").over(earlier), F.lit(0)).alias("__offset"))
        out = with_group(out, offsets, [*keys, "__bucket"], ["__offset"]).withColumn("before", F.col("before") + F.col("__offset")).drop("__offset")
    return out.drop("__bucket")


def in_buckets(values: DataFrame, keys: list[str], value: str, rows: int = ROWS) -> tuple[DataFrame, int]:
    """``values`` with ``__bucket``, which rises with the value within ``keys``, and how many buckets the largest group has."""
    n = max(1, -(-largest_group(values, keys) // rows))
    if n == 1:
        return values.withColumn("__bucket", F.lit(0)), 1
    shares = F.array(*(F.lit(k / n) for k in range(1, n)))
    cuts = values.where(~F.isnan(value)).groupBy(*keys).agg(F.percentile_approx(value, shares, F.lit(20 * n)).alias("__cuts"))
    found = with_group(values, cuts, keys, ["__cuts"])
    bucket = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: F.col(value) > c))
    return found.withColumn("__bucket", bucket).drop("__cuts"), n


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of their group, null keys included."""
    if not keys:
        return rows.crossJoin(F.broadcast(groups.select(*columns)))  # one row
    other = groups.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *columns)
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return rows.join(other, on, "left").select(*rows.columns, *columns)


def mid_rank(before: Column, n: Column) -> Column:
    """The mean of the 1-based ranks of ``n`` tied rows after ``before`` others."""
    return before + (n + 1) / F.lit(2.0)


def percent_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the mid-rank of ``value`` within ``keys`` as a share of the rows that have one."""
    if largest_group(df, keys) <= ROWS:
        group, ties = Window.partitionBy(*keys), Window.partitionBy(*keys, value)
        rank = F.rank().over(group.orderBy(F.col(value).asc_nulls_last())) - 1
        return df.withColumn(out, F.when(F.col(value).isNotNull(), mid_rank(rank, F.count("*").over(ties)) / F.count(value).over(group)))
    ranks = value_counts(df, keys, value)
    sizes = ranks.groupBy(*keys).agg(F.sum("n").alias("__size"))
    joined = with_group(ranks, sizes, keys, ["__size"]).withColumn(out, mid_rank(F.col("before"), F.col("n")) / F.col("__size"))
    return with_group(df, joined, [*keys, value], [out])


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group; one of no more than ROWS may be sorted in a task."""
    return df.groupBy(*keys).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0


def medians(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Medians of ``values`` by ``keys``, the mean of the middle two; null without any. NaN counts as the largest value."""
    long = df.select(*keys, F.inline(F.array(*(F.struct(F.lit(v).alias("__name"), F.col(v).cast("double").alias("__x")) for v in values))))
    ranks = value_counts(long, [*keys, "__name"], "__x")
    sizes = ranks.groupBy(*keys, "__name").agg(F.sum("n").alias("__size"))
    found = with_group(ranks, sizes, [*keys, "__name"], ["__size"])
    at = lambda place: F.max(F.when((F.col("before") < place) & (place <= F.col("before") + F.col("n")), F.col("__x")))
    middle = found.groupBy(*keys, "__name").agg(((at(F.floor((F.col("__size") + 1) / 2)) + at(F.floor(F.col("__size") / 2) + 1)) / 2).alias("__median"))
    return middle.groupBy(*keys).agg(*(F.max(F.when(F.col("__name") == v, F.col("__median"))).alias(v) for v in values))


def quantile_bin(ordinal: Column, n: Column, bins: int = 5) -> Column:
    """The bin of an ordinal rank when equal-width cuts are made at interpolated quantiles of the
    ordinals 1..n, right ends included; not the same as ``ntile``."""
    return F.greatest(F.lit(1), F.ceil(bins * (ordinal - 1) / F.nullif(n - 1, F.lit(0)).cast("double"))).cast("int")
