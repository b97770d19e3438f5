"""How much a section changed since the version that was public before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import keep


#: Most frequent terms of all sections whose statistics are broadcast.
HEAD = 20_000


def term_counts(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``term, tf`` of each document."""
    return docs.select(*keys, F.explode(tokens(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def point_in_time_pairs(reports: DataFrame, sections: DataFrame, least: int = 300, most: int = 430) -> DataFrame:
    """Each first version's found section with the latest version of the period before it
    (``least`` to ``most`` days earlier) that was public by then, whatever its number."""
    found = sections.where("status = 'found'").select("accession", "section", "text")
    versions = reports.select("accession", "cik", "fiscal_period_end", "accepted_at", "version_no").join(found, "accession")
    now = versions.where("version_no = 1").drop("version_no")
    prior = versions.select("cik", "section", *(F.col(c).alias(f"p_{c}") for c in ("accession", "fiscal_period_end", "accepted_at", "text")))
    gap = F.datediff("fiscal_period_end", "p_fiscal_period_end")
    pairs = now.join(prior, ["cik", "section"]).where(gap.between(least, most) & (F.col("p_accepted_at") < F.col("accepted_at")))
    latest = Window.partitionBy("accession", "section").orderBy(F.col("p_accepted_at").desc(), F.col("p_accession").desc())
    return pairs.withColumn("__n", F.row_number().over(latest)).where("__n = 1").select(
        "cik", "section", "accession", "fiscal_period_end", "accepted_at",
        F.col("p_accession").alias("prior_accession"), F.col("p_fiscal_period_end").alias("prior_period_end"),
        "text", F.col("p_text").alias("prior_text"),
    )


def _cosine(weight: Column | float = 1.0) -> Column:
    """Of two weighted term vectors in the columns ``a`` and ``b``; NaN where one is empty."""
    dot, na, nb = (F.sum(F.col(x) * F.col(y) * weight * weight) for x, y in (("a", "b"), ("a", "a"), ("b", "b")))
    return F.when((na == 0) | (nb == 0) | na.isNull(), F.lit(float("nan"))).otherwise(dot / (F.sqrt(na) * F.sqrt(nb)))


def _idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df).cast("double")) + 1


def section_changes(reports: DataFrame, sections: DataFrame) -> DataFrame:
    """Four similarities of each point-in-time pair, and both word counts.

    Term vectors of all paired documents are counted once and stay a distributed table.
    Inverse document frequencies are by section over paired documents: over all of them, and
    over those of years before the pair's acceptance year (NaN without any). A word unseen
    until then weighs as much as the rarest one seen.
    """
    # The keys of the pairs are made once; texts are read by document, not by pair.
    pairs = keep(point_in_time_pairs(reports, sections).drop("text", "prior_text"))
    wanted = pairs.select("accession", "section").unionByName(pairs.select(F.col("prior_accession").alias("accession"), "section")).distinct()
    docs = sections.where("status = 'found'").select("accession", "section", "text").join(wanted, ["accession", "section"])
    years = reports.groupBy("accession").agg(F.year(F.min("accepted_at")).alias("doc_year"))
    docs = docs.join(years, "accession")
    counts = keep(term_counts(docs, ["accession", "section", "doc_year"]))

    # Per (section, term): documents by year, an array no longer than there are years.
    by_year = counts.groupBy("section", "term", "doc_year").agg(F.count("*").alias("df"))
    stats = by_year.groupBy("section", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("doc_year", "df")).alias("years"))
    docs_by_year = docs.groupBy("section", "doc_year").agg(F.count("*").alias("docs"))
    totals = docs_by_year.groupBy("section").agg(F.sum("docs").alias("n"), F.collect_list(F.struct("doc_year", "docs")).alias("doc_years"))
    before = lambda rows, what, year: F.aggregate(F.filter(rows, lambda r: r["doc_year"] < year), F.lit(0).cast("long"), lambda s, r: s + r[what])
    targets = pairs.select("section", F.year("accepted_at").alias("year")).distinct()
    rarest = (
        stats.select("section", "years").join(targets, "section")
        .select("section", "year", before(F.col("years"), "df", F.col("year")).alias("df"))
        .where("df > 0").groupBy("section", "year").agg(F.min("df").alias("least_df"))
    )
    bounds = targets.join(totals, "section").join(rarest, ["section", "year"], "left")
    bounds = bounds.select("section", "year", "n", before(F.col("doc_years"), "docs", F.col("year")).alias("n_before"), "least_df")

    sides = pairs.select(
        "accession", "section", F.year("accepted_at").alias("year"),
        F.inline(F.array(F.struct(F.col("accession").alias("doc"), F.lit(1).alias("current")), F.struct(F.col("prior_accession").alias("doc"), F.lit(0).alias("current")))),
    )
    terms = sides.join(counts.select(F.col("accession").alias("doc"), "section", "term", "tf"), ["doc", "section"])
    terms = terms.groupBy("accession", "section", "year", "term").agg(
        F.sum(F.when(F.col("current") == 1, F.col("tf")).otherwise(0)).alias("a"), F.sum(F.when(F.col("current") == 0, F.col("tf")).otherwise(0)).alias("b")
    )
    # Terms that most documents have would each be one key of nearly all pairs: their statistics are sent to the pairs.
    terms, stats, on = keep(terms), keep(stats), ["section", "term"]
    head = F.broadcast(stats.orderBy(F.col("df").desc(), *on).limit(HEAD))
    weighed = terms.join(head, on).unionByName(terms.join(F.broadcast(head.select(*on)), on, "left_anti").join(stats, on))
    weighed = weighed.join(F.broadcast(bounds), ["section", "year"])  # a row by section and year
    seen = before(F.col("years"), "df", F.col("year"))
    pit = F.when(seen > 0, _idf(F.col("n_before"), seen)).otherwise(_idf(F.col("n_before"), F.col("least_df")))
    weighed = weighed.select("accession", "section", "a", "b", "n_before", _idf(F.col("n"), F.col("df")).alias("w"), pit.alias("wp"))
    a, b = F.col("a") > 0, F.col("b") > 0
    sims = weighed.groupBy("accession", "section").agg(
        F.sum("a").alias("words"), F.sum("b").alias("prior_words"),
        _cosine().alias("sim_cosine"),
        F.when((F.sum("a") > 0) & (F.sum("b") > 0), F.count_if(a & b) / F.count("*")).alias("sim_jaccard"),
        _cosine(F.col("w")).alias("sim_tfidf"),
        F.when(F.max("n_before") == 0, F.lit(float("nan"))).otherwise(_cosine(F.coalesce("wp", F.lit(0.0)))).alias("sim_tfidf_pit"),
    )
    out = pairs.join(sims, ["accession", "section"], "left")
    number = lambda c: F.coalesce(c, F.lit(float("nan"))).alias(c)
    return out.select(
        "cik", "section", "accession", "fiscal_period_end", "accepted_at", "prior_accession", "prior_period_end",
        F.coalesce("words", F.lit(0).cast("long")).alias("words"), F.coalesce("prior_words", F.lit(0).cast("long")).alias("prior_words"),
        *(number(c) for c in ("sim_cosine", "sim_jaccard", "sim_tfidf", "sim_tfidf_pit")),
    )


def pair_similarity(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Cosine and Jaccard similarity of the texts ``a`` and ``b`` of each row."""
    side = lambda name: pairs.select(*keys, F.explode(tokens(F.col(name))).alias("term"), F.lit(name).alias("side"))
    terms = side(a).unionByName(side(b)).groupBy(*keys, "term").agg(F.count_if(F.col("side") == a).alias("a"), F.count_if(F.col("side") == b).alias("b"))
    both = (F.sum("a") > 0) & (F.sum("b") > 0)
    shared = F.count_if((F.col("a") > 0) & (F.col("b") > 0)) / F.count("*")
    sims = terms.groupBy(*keys).agg(_cosine().alias("sim_cosine"), F.when(both, shared).alias("sim_jaccard"))
    number = lambda c: F.coalesce(c, F.lit(float("nan"))).alias(c)
    return pairs.select(*keys).join(sims, keys, "left").select(*keys, number("sim_cosine"), number("sim_jaccard"))
