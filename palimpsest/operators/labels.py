"""Labels and truths for models: events in windows around a report, and its stated revenue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The events' items, and the revenue concepts by preference.
EVENTS = {"bankruptcy": "1.03", "restatement": "4.02", "auditor_change": "4.01"}
REVENUE_CONCEPTS = (
    "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet",
    "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueGoodsNet",
)


def split_of(year: Column, train: int = 2017, validation: int = 2019) -> Column:
    return F.when(year <= train, "train").when(year <= validation, "val").otherwise("test")


def public_float(facts: DataFrame) -> DataFrame:
    """The largest positive public float in dollars of each report."""
    known = facts.where("concept = 'EntityPublicFloat' and unit = 'USD' and value > 0")
    return known.groupBy("accession").agg(F.max("value").alias("public_float"))


def event_labels(reports: DataFrame, filings: DataFrame, facts: DataFrame, horizon: Column, days: int = 365) -> DataFrame:
    """Whether each event was filed within ``days`` after a report's acceptance day (and,
    together, before it), for reports whose window had passed at ``horizon``.

    One join with the firm's events answers all windows at once.
    """
    due = reports.where(F.col("accepted_at") + F.make_dt_interval(F.lit(days)) <= horizon)
    wanted = filings.where(F.col("form") == "8-K").select("cik", "filing_date", "items")
    gap = F.datediff("filing_date", F.col("accepted_at").cast("date"))
    near = due.select("accession", "cik", "accepted_at").join(wanted, "cik").where(F.abs(gap).between(1, days))
    has = lambda item: F.contains(F.col("items"), F.lit(item))
    any_of = lambda side: F.bool_or(side & (has(EVENTS["bankruptcy"]) | has(EVENTS["restatement"]) | has(EVENTS["auditor_change"])))
    found = near.groupBy("accession").agg(*(F.bool_or((gap > 0) & has(item)).alias(name) for name, item in EVENTS.items()), any_of(gap < 0).alias("prior_event"))
    out = due.join(found, "accession", "left").join(public_float(facts), "accession", "left")
    flags = {name: F.coalesce(name, F.lit(False)) for name in (*EVENTS, "prior_event")}
    fy = F.year("fiscal_period_end")
    return out.withColumns(flags).select(
        "accession", "cik", fy.cast("long").alias("fy"), split_of(fy).alias("split"),
        F.col("public_float").isNotNull().alias("has_float"), F.log(1 + F.coalesce("public_float", F.lit(0.0))).alias("log_float"),
        (F.col("bankruptcy") | F.col("restatement") | F.col("auditor_change")).alias("label"), *EVENTS, "prior_event",
    )


def stated_revenue(reports: DataFrame, facts: DataFrame, concepts: tuple[str, ...] = REVENUE_CONCEPTS) -> DataFrame:
    """Full-year revenue of a report's own period: the preferred concept, of one concept the larger value."""
    place = F.array_position(F.array(*map(F.lit, concepts)), F.col("concept"))
    yearly = facts.where(F.col("concept").isin(*concepts) & (F.col("unit") == "USD") & F.datediff("period_end", "period_start").between(350, 380))
    joined = yearly.join(reports.select("accession", F.col("fiscal_period_end").alias("period_end")), ["accession", "period_end"])
    order = Window.partitionBy("accession").orderBy(place, F.col("value").desc())
    return joined.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("accession", "concept", F.col("value").alias("revenue_usd"))


def passage(text: Column, mention: str = r"(?iU)\b(?:revenues?|net sales|total sales|sales)\b", window: int = 6, most: int = 8000, prose: int = 300) -> Column:
    """Lines that mention the figure and the ``window`` after each, without long prose that
    has no digit, up to the line that would exceed ``most`` characters."""
    lines = F.split(text, "\n")
    # What is asked of a line is computed once, before the pass that carries the window and the size.
    seen = F.transform(lines, lambda x: F.struct(x.alias("line"), x.rlike(mention).alias("m"), (x.rlike("[0-9]") | (F.length(x) <= prose)).alias("ok"), F.length(x).alias("n")))
    state = F.struct(F.lit(0).alias("left"), F.lit(0).alias("size"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        left = F.when(x["m"], window + 1).otherwise(s["left"] - 1)
        wanted = (left > 0) & x["ok"] & ~s["full"]
        fits = s["size"] + x["n"] <= most
        return F.struct(
            left.alias("left"), F.when(wanted & fits, s["size"] + x["n"] + 1).otherwise(s["size"]).alias("size"), (s["full"] | (wanted & ~fits)).alias("full"),
            F.when(wanted & fits, F.array_append(s["kept"], x["line"])).otherwise(s["kept"]).alias("kept"),
        )

    return F.array_join(F.aggregate(seen, state, step)["kept"], "\n")


def extraction_scores(rows: DataFrame, prediction: str = "prediction", tolerance: float = 0.005) -> DataFrame:
    """How often predicted revenues are right, given and withheld; ``answerable`` and ``revenue_usd`` tell the truth."""
    p, truth, answerable = F.col(prediction), F.col("revenue_usd"), F.col("answerable")
    right = F.coalesce(F.abs(p - truth) <= tolerance * truth, F.lit(False)).cast("int")
    given = p.isNotNull().cast("int")
    rate = lambda flag, where=None: F.round(F.avg(flag if where is None else F.when(where, flag)), 3)
    return rows.agg(
        F.count_if(answerable).alias("answerable_n"), rate(right, answerable).alias("accuracy_answerable"), rate(given, answerable).alias("answered_answerable"),
        F.count_if(~answerable).alias("unanswerable_n"), rate(1 - given, ~answerable).alias("abstain_unanswerable"), rate(right).alias("accuracy_all"),
    )
