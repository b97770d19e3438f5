"""Which filers are studied, and what is still missing of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .versions import ANNUAL_FORMS

# Fixed value: industry codes of asset-backed issuers.
EXCLUDED_SIC = (6189,)


def exclusion(entity_type: Column, sic: Column) -> Column:
    """Why a filer does not qualify; null if it does."""
    kind = F.coalesce(entity_type, F.lit("None"))
    return F.when(kind != "operating", F.concat(F.lit("entity_type="), kind)).when(
        sic.isin(*EXCLUDED_SIC), F.concat(F.lit("sic="), sic.cast("string"), F.lit(" (asset-backed)"))
    )


def draw(filers: DataFrame, seed: int, wanted: int) -> DataFrame:
    """Filers in the order of a seeded hash, up to the ``wanted``-th that qualifies, with each decision.

    The order is cut into buckets by the hash's first two digits; counts per bucket tell how
    many qualified before it, so no task sorts all filers.
    """
    ranked = filers.select(
        "cik", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("cik").cast("string")), 256).alias("draw_rank"),
        exclusion(F.col("entity_type"), F.col("sic")).alias("reason"),
    ).withColumns({"ok": F.col("reason").isNull().cast("int"), "bucket": F.substring("draw_rank", 1, 2)})
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranked.groupBy("bucket").agg(F.sum("ok").alias("n")).select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket").orderBy("draw_rank")
    counted = ranked.withColumn("n", F.sum("ok").over(within)).join(F.broadcast(offsets), "bucket").withColumn("n", F.col("n") + F.col("offset"))
    taken = counted.where((F.col("n") < wanted) | ((F.col("n") == wanted) & (F.col("ok") == 1)))
    return taken.select("cik", "draw_rank", F.lit(seed).alias("seed"), F.when(F.col("ok") == 1, "included").otherwise("excluded").alias("status"), "reason")


def _missing(filings: DataFrame, headers: DataFrame, documents: DataFrame) -> DataFrame:
    h = headers.select("accession", F.lit(True).alias("__h"))
    d = documents.select("accession", F.lit(True).alias("__d"))
    joined = filings.join(h, "accession", "left").join(d, "accession", "left")
    return joined.withColumns({"needs_header": F.col("__h").isNull(), "needs_document": F.col("__d").isNull()}).where("needs_header or needs_document")


def fetch_plan(filings: DataFrame, headers: DataFrame, documents: DataFrame, first: str, last: str) -> DataFrame:
    """Annual filings of a window that lack their header or document."""
    annual = filings.where(F.col("form").isin(*ANNUAL_FORMS) & F.col("filing_date").between(first, last))
    return _missing(annual, headers, documents).select("accession", "cik", "needs_header", "needs_document")


def status(filings: DataFrame, headers: DataFrame, documents: DataFrame) -> DataFrame:
    """How many filings, firms and documents there are, and how many filings lack a part."""
    counts = filings.agg(F.count("*").alias("filings"), F.countDistinct("cik").alias("firms"))
    return counts.crossJoin(documents.agg(F.count("*").alias("documents"))).crossJoin(_missing(filings, headers, documents).agg(F.count("*").alias("incomplete")))
