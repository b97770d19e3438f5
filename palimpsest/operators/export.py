"""Nested records of each firm for a static viewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_number

# What an event's items mean, in this order.
KINDS = {"1.03": "bankruptcy", "2.01": "acquisition/disposition", "4.01": "auditor change", "4.02": "restatement"}


def kinds(items: Column) -> Column:
    return F.filter(F.array(*(F.when(F.contains(items, F.lit(i)), F.lit(k)) for i, k in KINDS.items())), lambda k: k.isNotNull())


def events(filings: DataFrame) -> DataFrame:
    """8-K filings, amended ones too, with an item of note, and their kinds."""
    noted = F.size(kinds(F.col("items"))) > 0
    rows = filings.where(F.col("form").startswith("8-K") & F.col("items").isNotNull() & noted)
    return rows.select("cik", F.col("filing_date").cast("string").alias("date"), "items", kinds(F.col("items")).alias("kinds"))


def report_rows(reports: DataFrame, tickers: DataFrame, floats: DataFrame, revenue: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per stored report version with what is known of it; numbers cleaned."""
    of = lambda c, section: F.max(F.when(F.col("section") == section, F.col(c)))
    changed = changes.groupBy("accession").agg(
        of("sim_tfidf_pit", "risk_factors").alias("sim_rf"), of("sim_tfidf_pit", "mdna").alias("sim_mdna"), of("words", "risk_factors").alias("words_rf"), of("words", "mdna").alias("words_mdna")
    )
    joined = reports.where("stored_path is not null")
    for other, columns in ((tickers, ["ticker"]), (floats, ["public_float"]), (revenue, ["revenue_usd"]), (changed, ["sim_rf", "sim_mdna", "words_rf", "words_mdna"])):
        joined = joined.join(other.select("accession", *columns), "accession", "left")
    return joined.select(
        "cik", "accession", "form", "is_amendment", "version_no", F.year("fiscal_period_end").cast("long").alias("fy"), F.col("fiscal_period_end").cast("string").alias("period_end"),
        F.date_format("accepted_at_et", "yyyy-MM-dd HH:mm").alias("accepted_et"), "dated_next_business_day", "ticker",
        clean_number(F.col("public_float")).alias("public_float"), clean_number(F.col("revenue_usd")).alias("revenue"),
        clean_number(F.col("sim_rf")).alias("sim_rf"), clean_number(F.col("sim_mdna")).alias("sim_mdna"), "words_rf", "words_mdna",
    )


def firms(filers: DataFrame, rows: DataFrame, noted: DataFrame) -> DataFrame:
    """One nested record per filer with a stored report: its reports by period and version, its events by date."""
    report = F.struct(*[c for c in rows.columns if c != "cik"])
    order = lambda *c: F.struct(*c, report.alias("__r"))
    by_firm = rows.groupBy("cik").agg(F.transform(F.array_sort(F.collect_list(order(F.col("period_end").isNull(), "period_end", "version_no", "accession"))), lambda r: r["__r"]).alias("reports"))
    event = F.struct("date", "items", "kinds")
    by_event = noted.groupBy("cik").agg(F.array_sort(F.collect_list(event)).alias("events"))
    joined = filers.select("cik", "name", "industry", "current_tickers").join(by_firm, "cik").join(by_event, "cik", "left")
    return joined.withColumn("events", F.coalesce("events", F.array().cast("array<struct<date:string,items:string,kinds:array<string>>>")))


def firm_index(records: DataFrame) -> DataFrame:
    """The viewer's list: one flat row per firm."""
    originals = F.filter("reports", lambda r: r["version_no"] == 1)
    tickers = F.filter(F.transform(originals, lambda r: r["ticker"]), lambda t: t.isNotNull())
    sims = F.filter(F.transform(originals, lambda r: r["sim_rf"]), lambda x: x.isNotNull())
    return records.select(
        "cik", "name", "industry", F.try_element_at(tickers, F.lit(-1)).alias("ticker"),
        F.array_min(F.transform(originals, lambda r: r["fy"])).alias("first_fy"), F.array_max(F.transform(originals, lambda r: r["fy"])).alias("last_fy"),
        F.size(originals).cast("long").alias("reports"), F.size("events").cast("long").alias("events"), F.array_min(sims).alias("min_sim_rf"), F.col("current_tickers").isNotNull().alias("has_current_ticker"),
    )


def search(index: DataFrame, text: str = "", order: str = "min_sim_rf", most: int = 150) -> DataFrame:
    """The viewer's list filtered by name, ticker, id or industry, biggest rewrite first, nulls last."""
    wanted = text.strip().lower()
    if wanted:
        has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(wanted))
        index = index.where(has("name") | has("industry") | (F.lower("ticker") == wanted) | (F.col("cik").cast("string") == wanted))
    return index.orderBy(F.col(order).asc_nulls_last(), "name", "cik").limit(most)


def counts(reports: DataFrame, changes: DataFrame) -> DataFrame:
    """The summary's totals."""
    kept = reports.where("stored_path is not null").agg(
        F.count("*").alias("reports"), F.countDistinct("cik").alias("firms"), F.count_if("is_amendment").alias("amendments"),
        F.min(F.year("fiscal_period_end")).cast("long").alias("first_fy"), F.max(F.year("fiscal_period_end")).cast("long").alias("last_fy"),
    )
    return kept.crossJoin(changes.agg(F.count("*").alias("section_pairs")))  # one row each
