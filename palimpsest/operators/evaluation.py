"""Scoring of scores: ranking quality with intervals that resample clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import in_buckets, value_counts
from ..session import keep
from .reports import area_under_curve

DRAWS = 2000


def roc_auc(rows: DataFrame, score: str = "score", label: str = "label", keys: list[str] | None = None) -> DataFrame:
    """The area under the ROC curve, ties counting half."""
    keyed = rows if keys else rows.withColumn("__all", F.lit(1))
    out = area_under_curve(keyed, keys or ["__all"], score, label)
    return out if keys else out.drop("__all")


def average_precision(rows: DataFrame, score: str = "score", label: str = "label", keys: list[str] | None = None) -> DataFrame:
    """Precision at each threshold weighted by the recall it adds (a step sum)."""
    keys_ = keys or ["__all"]
    keyed = (rows if keys else rows.withColumn("__all", F.lit(1))).where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = value_counts(keyed.withColumn("__down", -F.col(score)), keys_, "__down", positives=F.col(label).cast("int"))
    hits = value_counts(keyed.where(F.col(label).cast("int") == 1).withColumn("__down", -F.col(score)), keys_, "__down")
    hits = hits.select(*keys_, "__down", F.col("before").alias("hits_before"))
    gained = counts.where("positives > 0").join(hits, [*keys_, "__down"])  # other thresholds add no recall
    precision = (F.col("hits_before") + F.col("positives")) / (F.col("before") + F.col("n"))
    out = gained.groupBy(*keys_).agg((F.sum(precision * F.col("positives")) / F.sum("positives")).alias("average_precision"))
    return out if keys else out.drop("__all")


def multiplicity(draw: Column, cluster: Column, most: int = 8) -> Column:
    """How often a cluster is in a draw: Poisson of mean one, from a hash of both."""
    u = F.conv(F.substring(F.md5(F.concat(draw.cast("string"), F.lit(":"), cluster.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(most):
        total += term
        term /= k + 1
        out = out + (u >= total).cast("int")
    return out


def cluster_bootstrap(rows: DataFrame, cluster: str, score: str = "score", label: str = "label", draws: int = DRAWS, other: str | None = None) -> DataFrame:
    """A 95 % interval of the AUC (or of its difference to that of ``other``) over draws of whole clusters.

    Rows are summed per cluster, score and label first. Each draw weighs clusters by a hash,
    so draws are independent and a rerun gives the same numbers. A draw's scores are ranked
    in buckets, whose sums then meet by draw. Draws of one class are left out.
    """
    names = [score] + ([other] if other else [])
    ones = rows.where(F.col(label).isNotNull())
    for n in names:
        ones = ones.where(F.col(n).isNotNull())
    # A cluster's multiplicities are hashed once, not for each of its scores.
    times = ones.select(cluster).distinct().select(cluster, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    times = times.withColumn("m", multiplicity(F.col("draw"), F.col(cluster))).where("m > 0")
    per_draw = []
    for name in names:
        counted = keep(ones.groupBy(cluster, name).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("p")))
        counted, _ = in_buckets(counted, [], name)
        drawn = counted.join(times, cluster)
        sums = drawn.groupBy("draw", "__bucket", name).agg(F.sum(F.col("n") * F.col("m")).alias("n"), F.sum(F.col("p") * F.col("m")).alias("p"))
        within = Window.partitionBy("draw", "__bucket").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        ranked = sums.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
        parts = ranked.groupBy("draw", "__bucket").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("p") * (F.col("before") + (F.col("n") + 1) / 2.0)).alias("r"))
        earlier = Window.partitionBy("draw").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        n1, total = F.sum("p"), F.sum("n")
        u = F.sum(F.col("r") + F.col("p") * F.col("offset")) - n1 * (n1 + 1) / 2.0
        per_draw.append(parts.groupBy("draw").agg(F.try_divide(u, (n1 * (total - n1)).cast("double")).alias(f"auc{len(per_draw)}")))
    joined = per_draw[0] if not other else per_draw[0].join(per_draw[1], "draw")
    value = F.col("auc0") if not other else F.col("auc0") - F.col("auc1")
    known = joined.select(value.alias("x")).where("x is not null")
    return known.agg(F.count("*").alias("draws"), F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"))


def moments(x: Column) -> tuple[Column, Column]:
    """Bias-corrected skewness, and kurtosis that is 3 for a normal distribution."""
    n, g1, g2 = F.count(x).cast("double"), F.skewness(x), F.kurtosis(x)
    skew = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)) + 3
    return F.when(n > 2, skew), F.when(n > 3, kurt)
