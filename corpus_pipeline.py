"""A corpus pipeline: each stage takes all documents its predecessor kept.

``run`` applies the stages to ``documents``, writing what each returns as Parquet in the
shared folder and reading it again as the next one's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, exact_dedup, queries, rule_ensemble, simhash
from palimpsest.llm.common import remove, shared_folder, table


def _packed(docs: DataFrame) -> DataFrame:
    """The other columns as one, so that no result can replace one, and the text."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text"), F.lit(0).alias("__")).alias("__row"), "text")


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c if c == "text" else f"__row.{c}").alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents' labels, does not reject."""
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"))
    return _unpacked(rule_ensemble.score(_packed(docs), model).where("predicted = 1"), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the largest id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item: eight words in a row of one, or a whole shorter one."""
    found = decontaminate.find_windows(_packed(docs), table(spark, sf_dir, "benchmark"))
    return _unpacked(found.where("size(items) = 0"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the documents' token ids and of what these decode to."""
    return queries.bpe_digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE", encode),
]

#: SQL cannot express the classifier, XXH64 or the merges; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's folder goes when the next one has been written; the last one stays, as the result."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
