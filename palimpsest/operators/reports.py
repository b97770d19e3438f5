"""Findings: small summaries of the base tables and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import medians, mid_rank, value_counts, with_group
from ..functions.times import api_instant, days_between, local_time, trading_session


def _percent(flag: Column) -> Column:
    return F.round(100.0 * F.avg(flag.cast("int")), 1)


def _share(over) -> Column:
    return F.round(100.0 * F.col("n").cast("double") / F.sum("n").over(over), 1)


def sample(universe: DataFrame) -> DataFrame:
    """Decisions on candidates by status and reason."""
    return universe.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("filers"))


def coverage(reports: DataFrame) -> DataFrame:
    """Accepted reports by filing year."""
    return reports.where("accepted_at is not null").groupBy(F.year("filing_date").cast("long").alias("filing_year")).agg(
        F.count("*").alias("reports"),
        F.count_if("is_amendment").alias("amendments"),
        F.count("stored_path").alias("with_text"),
        F.countDistinct("cik").alias("firms"),
    )


def timing(reports: DataFrame) -> DataFrame:
    """When reports become public, and how often the filing date is a later day."""
    minute = F.hour("accepted_at_et") * 60 + F.minute("accepted_at_et")
    return reports.where("accepted_at is not null").agg(
        F.count("*").alias("reports"),
        _percent(F.col("dated_next_business_day")).alias("pct_dated_next_business_day"),
        _percent(minute >= 960).alias("pct_after_close"),
        _percent(minute < 570).alias("pct_before_open"),
    )


def api_offsets(clock: DataFrame) -> DataFrame:
    """Distribution of the filing list's clock error."""
    counted = clock.groupBy(F.col("api_minus_header_hours").alias("hours_off")).agg(F.count("*").alias("n"))
    return counted.select("hours_off", F.col("n").alias("filings"), _share(Window.partitionBy()).alias("pct"))


def session_flips(clock: DataFrame) -> DataFrame:
    """Filings that the filing list's clock puts into another trading session."""
    header = trading_session(local_time(F.col("accepted_at")))
    api = trading_session(local_time(api_instant(F.col("accepted_api_raw"))))
    return clock.select((header != api).alias("flip")).agg(
        F.count("*").alias("filings"), F.count_if("flip").alias("session_flips"), _percent(F.col("flip")).alias("pct_flipped")
    )


def amendments(reports: DataFrame) -> DataFrame:
    """How often and how late a period's report is amended."""
    periods = reports.where("accepted_at is not null").groupBy("cik", "fiscal_period_end").agg(
        (F.count("*") - 1).alias("amended"), days_between(F.min("accepted_at"), F.max("accepted_at")).alias("days")
    )
    return periods.agg(
        F.count("*").alias("fiscal_periods"),
        _percent(F.col("amended") > 0).alias("pct_amended"),
        F.max("amended").alias("max_amendments"),
        F.median(F.when(F.col("amended") > 0, F.col("days"))).alias("median_days_to_amendment"),
    )


def period_disagreement(filings: DataFrame, headers: DataFrame) -> DataFrame:
    """Filing list's period against the header's."""
    return filings.join(headers.select("accession", "header_period"), "accession").agg(
        F.count("*").alias("reports"),
        F.count_if(F.col("report_date").isNull()).alias("api_period_missing"),
        F.count_if(F.col("report_date") != F.col("header_period")).alias("disagree"),
    )


def storage(documents: DataFrame) -> DataFrame:
    """Gigabytes as read and as stored."""
    raw, stored = F.sum("bytes_raw"), F.sum("bytes_stored")
    return documents.agg(
        F.count("*").alias("documents"),
        F.round(raw / 1e9, 2).alias("raw_gb"),
        F.round(stored / 1e9, 2).alias("stored_gb"),
        F.round(F.try_divide(raw.cast("double"), stored.cast("double")), 1).alias("compression"),
    )


def section_outcomes(sections: DataFrame, reports: DataFrame) -> DataFrame:
    """Extraction outcomes on originals, with their share of the section."""
    originals = reports.where(~F.col("is_amendment")).select("accession")
    counted = sections.join(originals, "accession").groupBy("section", "status").agg(F.count("*").alias("n"))
    return counted.select("section", "status", F.col("n").alias("reports"), _share(Window.partitionBy("section")).alias("pct"))


def change_summary(changes: DataFrame) -> DataFrame:
    """Medians of the similarities, by section."""
    names = ["sim_cosine", "sim_jaccard", "sim_tfidf"]
    middle = medians(changes, ["section"], names).select("section", *(F.round(n, 3).alias(n.replace("sim", "median")) for n in names))
    counted = changes.groupBy("section").agg(F.count("*").alias("pairs"), F.countDistinct("cik").alias("firms"), _percent(F.col("sim_cosine") > 0.9995).alias("pct_near_verbatim"))
    found = with_group(counted, middle, ["section"], [n.replace("sim", "median") for n in names])
    return found.select("section", "pairs", "firms", "median_cosine", "median_jaccard", "median_tfidf", "pct_near_verbatim")


def area_under_curve(rows: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """By ``keys``: positives, negatives and the chance that a positive's score exceeds a
    negative's, ties counting half (null without both). Null and NaN scores are left out.

    Only counts per distinct score are ranked, in buckets (see ``functions.ranks``).
    """
    known = rows.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())
    counts = value_counts(known, keys, score, positives=F.col(label).cast("int"))
    n1, n = F.sum("positives"), F.sum("n")
    u = F.sum(F.col("positives") * mid_rank(F.col("before"), F.col("n"))) - n1 * (n1 + 1) / 2.0
    return counts.groupBy(*keys).agg(n1.alias("positives"), (n - n1).alias("negatives"), F.try_divide(u, (n1 * (n - n1)).cast("double")).alias("auc"))


def with_event_between(changes: DataFrame, reports: DataFrame, events: DataFrame, item: str = "2.01", flag: str = "had_deal") -> DataFrame:
    """``changes`` with whether an 8-K with ``item`` was filed strictly between the prior
    report's acceptance day and this one's (UTC days)."""
    since = reports.select(F.col("accession").alias("prior_accession"), F.col("accepted_at").cast("date").alias("__from"))
    wanted = events.where((F.col("form") == "8-K") & F.col("items").contains(item))
    days = wanted.groupBy("cik").agg(F.collect_set("filing_date").alias("__days"))  # no more than there are days
    inside = F.exists("__days", lambda d: (d > F.col("__from")) & (d < F.col("accepted_at").cast("date")))
    out = changes.join(since, "prior_accession", "left").join(days, "cik", "left")
    return out.select(*changes.columns, F.coalesce(inside, F.lit(False)).alias(flag))


def event_auc(changes: DataFrame, reports: DataFrame, events: DataFrame) -> DataFrame:
    """Whether pairs around an event are less similar, by section and measure."""
    marked = with_event_between(changes, reports, events)
    measures = [F.struct(F.lit(m).alias("measure"), (-F.col(f"sim_{m}")).alias("distance")) for m in ("cosine", "jaccard", "tfidf")]
    long = marked.select("section", "had_deal", F.inline(F.array(*measures)))
    out = area_under_curve(long, ["section", "measure"], "distance", "had_deal")
    return out.select("section", "measure", F.col("positives").alias("deal_pairs"), F.col("negatives").alias("other_pairs"), F.round("auc", 3).alias("auc"))
