"""New paragraphs: distances to the nearest earlier one, and lightly edited pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.text import jaccard, paragraphs, word_set
from .reports import with_event_between


#: Vectors of either side that meet in a task.
PART = 8192


def labelled_pairs(changes: DataFrame, reports: DataFrame, events: DataFrame, sections: DataFrame) -> DataFrame:
    """Change pairs with both texts and whether a deal fell between them."""
    marked = with_event_between(changes, reports, events)
    texts = sections.select("accession", "section", "text")
    prior = texts.select(F.col("accession").alias("prior_accession"), "section", F.col("text").alias("prior_text"))
    joined = marked.join(texts, ["accession", "section"]).join(prior, ["prior_accession", "section"])
    return joined.select("cik", "section", "accession", "prior_accession", F.year("fiscal_period_end").alias("fy"), "sim_tfidf", "had_deal", "text", "prior_text")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def novelty(current: DataFrame, prior: DataFrame, keys: list[str], vector: str = "embedding", weight: str = "weight") -> DataFrame:
    """Mean distance (1 - cosine) of the current paragraphs to the nearest prior one, by ``keys``, weighted.

    Vectors need not be normalised; only those of one length are compared. Keys with no prior
    paragraph have none. Both sides of a key are dealt to parts of about PART rows, and each two
    parts meet in a task of their own, as two matrices; equal prior vectors count once.
    """
    group = [*keys, "__d"]
    left, right = _vectors(current, vector), _vectors(prior, vector)
    parts = lambda df, name: df.groupBy(*group).agg(F.ceil(F.count("*") / PART).alias(name))
    sizes = parts(left, "__m").join(parts(right, "__n"), group)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cur = left.select(*group, "__v", F.struct(*[c for c in current.columns if c != vector]).alias("__id"), F.col(weight).alias("__w")).join(sizes, group)
    cur = cur.select(*group, "__v", "__id", "__w", F.pmod(F.xxhash64("__id"), "__m").alias("__i"), each("__n").alias("__j"))
    past = right.select(*group, "__v").distinct().join(sizes, group)
    past = past.select(*group, "__v", F.pmod(F.xxhash64("__v"), "__n").alias("__j"), each("__m").alias("__i"))
    kept, on = [*keys, "__id", "__w"], [*group, "__i", "__j"]

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        near = _nearest(_matrix(a["__v"]), _matrix(b["__v"])) if a.num_rows and b.num_rows else np.empty(0)
        return a.select(kept).slice(0, len(near)).append_column("__near", pa.array(near, pa.float64()))

    schema = cur.select(*kept, F.lit(None).cast("double").alias("__near")).schema
    met = cur.groupBy(*on).cogroup(past.groupBy(*on)).applyInArrow(nearest, schema)
    best = met.groupBy(*keys, "__id").agg(F.max("__near").alias("near"), F.first("__w").alias("__w"))
    distance = 1 - F.least(F.col("near"), F.lit(1.0))
    return best.groupBy(*keys).agg((F.sum(distance * F.col("__w")) / F.sum("__w")).alias("novelty"), F.count("*").alias("paragraphs"))


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of some length and no nulls, as ``__v`` of ``__d`` numbers."""
    single = df.schema[vector].dataType == ArrayType(FloatType(), df.schema[vector].dataType.containsNull)
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    return df.withColumns({"__v": v, "__d": F.size(vector)}).where(dot(F.col("__v"), F.col("__v")) > 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(float).reshape(len(column), -1)


def _nearest(a: np.ndarray, b: np.ndarray, step: int = 256) -> np.ndarray:
    """For each row of ``a`` the largest cosine with a row of ``b``; a few rows at a time, to bound the products held."""
    size = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x))
    n, m = size(a), size(b)
    return np.concatenate([(a[k : k + step] @ b.T / np.outer(n[k : k + step], m)).max(axis=1) for k in range(0, len(a), step)])


def edit_pairs(pairs: DataFrame, keys: list[str], text: str = "text", prior: str = "prior_text", least: float = 0.6, most: float = 0.95, size: int = 200) -> DataFrame:
    """Each current paragraph with its best earlier version, where the words overlap by
    ``least`` up to ``most``; the first of equally good ones."""
    cur = pairs.select(*keys, F.posexplode(paragraphs(F.col(text), size)).alias("place", "paragraph"), F.col(prior))
    # Each paragraph meets at most 300 earlier ones, in one row.
    found = F.transform(paragraphs(F.col(prior), size), lambda p, i: F.struct(jaccard(word_set(F.col("paragraph")), word_set(p)).alias("overlap"), (-i).alias("order"), p.alias("prior_paragraph")))
    best = F.array_max(F.filter(found, lambda f: (f["overlap"] > 0) & ~F.isnan(f["overlap"])))
    return cur.select(*keys, "place", "paragraph", best.alias("b")).where((F.col("b.overlap") >= least) & (F.col("b.overlap") < most)).select(
        *keys, "place", "paragraph", "b.prior_paragraph", "b.overlap"
    )
