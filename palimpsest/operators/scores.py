"""What surrounds a text model: windows of a document, means of their scores, batches, samples, and its outputs."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import percent_rank, value_counts, with_group
from ..functions.text import parse_answer
from .learn import logistic, with_score

# Tokens of a window (the model's 512 less the two marks at its ends), and windows scored of a document.
WIDTH, WINDOWS = 510, 64


def windows(ids: Column, width: int = WIDTH, most: int | None = WINDOWS) -> Column:
    """An array's windows of ``width`` items side by side, the last one shorter; at least one, which may be empty, and at most ``most``."""
    n = F.greatest(F.ceil(F.size(ids) / width).cast("int"), F.lit(1))
    n = F.least(n, F.lit(most)) if most else n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(ids, k * width + 1, width))


def mean_scores(scored: DataFrame, key: str, score: str = "score") -> DataFrame:
    """A document's score: the mean of its windows'."""
    return scored.groupBy(key).agg(F.count("*").alias("windows"), F.avg(score).alias(score))


def shuffled(rows: DataFrame, *names: str, seed: int = 7) -> DataFrame:
    """``rows`` with ``place``, a random number that a seed and the columns ``names`` fix, whatever the partitions."""
    return rows.withColumn("place", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *(F.col(n).cast("string") for n in names))))


def sample(rows: DataFrame, most: int, *names: str, seed: int = 7) -> DataFrame:
    """``most`` rows in a seeded random order; the limit is the point. Each task passes on no more than that."""
    return shuffled(rows, *names, seed=seed).orderBy("place", *names).limit(most)


def sample_by(rows: DataFrame, by: str, most: int, *names: str, seed: int = 7) -> DataFrame:
    """Up to ``most`` random rows for each value of ``by``, which tells documents; ``names`` tell their rows."""
    order = Window.partitionBy(by).orderBy("place", *names)
    return shuffled(rows, by, *names, seed=seed).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def length_batches(rows: DataFrame, length: str, size: int, *names: str) -> DataFrame:
    """``rows`` with ``batch`` and ``width``: numbers of batches of ``size`` rows in order of length, and the batch's greatest.

    Rows of one length, told by ``names``, stand in one task; lengths before them are counted, not sorted.
    """
    before = value_counts(rows.withColumn("__length", F.col(length).cast("double")), [], "__length")
    found = with_group(rows.withColumn("__length", F.col(length).cast("double")), before.select("__length", "before"), ["__length"], ["before"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("__length").orderBy(*names)) - 1
    found = found.withColumn("batch", F.floor(place / size)).drop("before", "__length")
    widths = found.groupBy("batch").agg(F.max(length).alias("width"))
    return found.join(widths, "batch")


def model_outputs(risk: DataFrame | None, revenue: DataFrame | None) -> DataFrame | None:
    """What models say of each report that any of them saw.

    ``risk`` (``accession, label, score``) gives the label and the score's percentile among its
    reports, ``revenue`` (``accession, answerable, qlora, zero_shot``) the figures its answers
    name. With one of them absent the other stands alone; with none there is nothing.
    """
    out = None
    if risk is not None:
        out = percent_rank(risk, [], "score", "risk_pct").select("accession", F.col("label").alias("event_next_12m"), "risk_pct")
    if revenue is not None:
        told = revenue.select("accession", "answerable", parse_answer(F.col("qlora")).alias("qlora_usd"), parse_answer(F.col("zero_shot")).alias("zero_shot_usd"))
        out = told if out is None else out.join(told, "accession", "full")
    return out


def with_outputs(reports: DataFrame, outputs: DataFrame | None) -> DataFrame:
    """The export's report rows with what models say of them; others stay."""
    return reports if outputs is None else reports.join(outputs, "accession", "left")


def stacked(validation: DataFrame, test: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """``test`` with ``score``: a regression on ``columns``, another model's score among them, fitted on ``validation``. All rows weigh one."""
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    model = logistic(assembler.transform(validation).withColumn("weight", F.lit(1.0)), label=label, iterations=1000)
    return with_score(model, assembler.transform(test).drop("score")).drop("features")


def precision_when_answering(scores: DataFrame) -> DataFrame:
    """``scores`` (one row of :func:`..labels.extraction_scores`) with the share of given answers that were right; NaN without any."""
    given = F.col("answered_answerable") * F.col("answerable_n") + (1 - F.col("abstain_unanswerable")) * F.col("unanswerable_n")
    right = F.col("accuracy_all") * (F.col("answerable_n") + F.col("unanswerable_n"))
    return scores.withColumn("precision_when_answering", F.when(given > 0, right / given).otherwise(F.lit(float("nan"))))
