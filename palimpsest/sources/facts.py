"""Structured facts: nested JSON to one row per concept, unit, period and filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The concepts that are kept, by taxonomy.
CONCEPTS = {
    "dei": ("EntityPublicFloat", "EntityCommonStockSharesOutstanding"),
    "us-gaap": (
        "Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax",
        "SalesRevenueNet", "SalesRevenueGoodsNet", "Assets", "NetIncomeLoss",
    ),
}
SCHEMA = "cik bigint, facts map<string, map<string, struct<units: map<string, array<struct<val:double, start:string, `end`:string, accn:string, fy:int, fp:string, form:string, filed:string>>>>>>"
_KEY = ("cik", "taxonomy", "concept", "unit", "period_start", "period_end", "accession")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def from_text(rows: DataFrame, column: str = "value") -> DataFrame:
    return rows.select(F.from_json(F.col(column), SCHEMA).alias("d")).select("d.*")


def fact_id() -> Column:
    """SHA-1 of the identifying fields; an instant has no start, written as ``None``."""
    return F.sha1(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in _KEY)))


def rows(docs: DataFrame) -> DataFrame:
    """Facts of the kept concepts; of repeats the last in document order."""
    kept = F.lit(False)
    for taxonomy, concepts in CONCEPTS.items():
        kept = kept | ((F.col("taxonomy") == taxonomy) & F.col("concept").isin(*concepts))
    by_concept = docs.select("cik", F.explode("facts").alias("taxonomy", "c")).select("cik", "taxonomy", F.explode("c").alias("concept", "f")).where(kept)
    by_value = by_concept.select("cik", "taxonomy", "concept", F.explode("f.units").alias("unit", "v")).select("cik", "taxonomy", "concept", "unit", F.posexplode("v").alias("place", "x"))
    flat = by_value.select(
        "cik", "taxonomy", "concept", "unit", F.col("x.val").alias("value"), F.col("x.start").try_cast("date").alias("period_start"), F.col("x.end").try_cast("date").alias("period_end"),
        F.col("x.accn").alias("accession"), "x.fy", "x.fp", "x.form", F.col("x.filed").try_cast("date").alias("filed"), "place",
    ).withColumn("fact_id", fact_id())
    columns = [c for c in flat.columns if c not in ("place", "fact_id")]
    last = flat.groupBy("fact_id").agg(F.max_by(F.struct(*columns), "place").alias("r"))
    return last.select("fact_id", "r.*")


def missing(filers: DataFrame, held: DataFrame, failed: DataFrame, url: Column, sentinel: str = "Assets") -> DataFrame:
    """Filers without the sentinel concept whose URL has not failed before."""
    done = held.where(F.col("concept") == sentinel).select("cik").distinct()
    return filers.join(done, "cik", "left_anti").withColumn("url", url).join(failed.select("url"), "url", "left_anti")
