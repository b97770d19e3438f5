"""SimHash near-dedup: fingerprints of word shingles, linked through pivot distance tables.

Equal fingerprints are one class from the start. Two classes can differ in at most BITS
bits only if two of six bands agree, so classes meet in the buckets of the 15 pairs of
bands, some 30 million buckets. 10^10 classes are about 5,000 in each, and 4 * 10^14 pairs of
rows of distances in all, which is minutes on a thousand executors.

In a bucket, each fingerprint has a row of precomputed Hamming distances to PIVOTS reference
fingerprints; by the triangle inequality a pair whose rows differ by more than BITS in some
coordinate is discarded, and only survivors are compared bit by bit. A bucket passes on a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, salt, unused, with_least
from .components import components

BITS = 4
SHINGLE = 4
SEED = 42
PIVOTS = 32
#: A bucket of more classes is cut into chunks of about this size, and pairs of chunks are compared in separate tasks.
CHUNK = 4096
#: Large buckets' list is broadcast only up to so many rows.
BROADCAST_ROWS = 100_000
_WIDTHS = (11, 11, 11, 11, 10, 10)
_AT_ONCE = 65_536


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's UTF-8, unsigned; zero without words."""
    joined = b" ".join(raw.lower().split())
    if not joined:
        return 0
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(blanks + 1).tolist()], [*blanks.tolist(), len(joined)]
    n = max(1, len(starts) - size + 1)
    last = ends[size - 1 :] if len(ends) >= size else ends[-1:]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, n, _AT_ONCE):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : min(i + _AT_ONCE, n)], last[i : i + _AT_ONCE])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, fp`` of each row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(2)
            made = np.array([fingerprint(raws[k].as_py() or b"") for k in range(len(raws))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made.view(np.int64))], names=["doc_id", "text_key", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).cast("binary").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _bands(fp: Column) -> list[Column]:
    out, shift = [], 0
    for width in _WIDTHS:
        out.append(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)))
        shift += width
    return out


def _keys(fp: Column) -> Column:
    """Of each pair of bands: its number and the bits of both."""
    bands = _bands(fp)
    return F.array(*(F.lit(k << 40) + F.shiftleft(bands[i], 20) + bands[j] for k, (i, j) in enumerate(combinations(range(len(_WIDTHS)), 2))))


def _pivots(n: int = PIVOTS) -> np.ndarray:
    draw = random.Random(0)
    return np.array([draw.getrandbits(64) for _ in range(n)], np.uint64)


def _linked(groups: np.ndarray, fps: np.ndarray, sides: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of the same group.

    Rows come sorted by group; sides: 0 or 1 in a comparison of two chunks (only pairs of
    different sides count), 2 where all pairs do.
    """
    distances = np.bitwise_count(fps[:, None] ^ _pivots()[None, :]).astype(np.int8)
    labels, forest, rows = np.arange(len(fps)), [], np.arange(len(fps))
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shift = 1
    while len(rows := rows[rows + shift < len(fps)]) and len(rows := rows[groups[rows] == groups[rows + shift]]):
        i, j = rows, rows + shift
        pick = (labels[i] != labels[j]) & ((sides[i] == 2) | (sides[i] != sides[j]))
        i, j = i[pick], j[pick]
        pick = np.abs(distances[i] - distances[j]).max(axis=1, initial=0) <= bits
        i, j = i[pick], j[pick]
        pick = np.bitwise_count(fps[i] ^ fps[j]) <= bits
        i, j = i[pick], j[pick]
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                forest.append((a, b))
        if len(i):
            labels = np.array(parent)
            while (further := labels[labels]).tobytes() != labels.tobytes():
                labels = further
            parent = labels.tolist()
        shift += 1
    return forest


def _compare(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            names = np.cumsum(np.concatenate(([0], (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])))) if len(rows) else rows[:, 0]
            forest = np.array(_linked(names, rows[:, 2].view(np.uint64), rows[:, 3], bits), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rows[forest[:, k], 2]) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            own = (rows[:, :2] == rows[-1, :2]).all(axis=1)
            start = int(np.flatnonzero(~own)[-1]) + 1 if not own.all() else 0  # of the last group, which may go on
            if start:
                yield emit(np.ascontiguousarray(np.concatenate([*held, rows[:start]])))
                held = []
            elif held and (held[-1][-1, :2] != rows[0, :2]).any():
                yield emit(np.ascontiguousarray(np.concatenate(held)))
                held = []
            held.append(rows[start:])
        if held:
            yield emit(np.ascontiguousarray(np.concatenate(held)))

    return run


def links(classes: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: edges that connect the same fingerprints (column ``fp``, distinct) as all links do."""
    if bits > BITS:
        raise ValueError(f"two of six bands agree only up to {BITS} differing bits")
    rows = classes.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    large = keep(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    many = large.count()
    if many:
        rows = rows.join(F.broadcast(large) if many <= BROADCAST_ROWS else large, "key", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("chunks") - 1),
            lambda x: F.struct(
                (F.least(x, own).cast("long") * F.col("chunks") + F.greatest(x, own)).alias("part"),
                F.when(x == own, 2).when(own < x, 0).otherwise(1).cast("long").alias("side"),
            ),
        )
        alone = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.lit(2).cast("long").alias("side")))
        rows = rows.select("key", "fp", F.explode(F.when(F.col("chunks").isNull(), alone).otherwise(pairs)).alias("p")).select("key", "p.part", "fp", "p.side")
    else:
        rows = rows.select("key", F.lit(0).cast("long").alias("part"), "fp", F.lit(2).cast("long").alias("side"))
    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_compare(bits), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id, kept``, and ``text_key``.

    ``component_id`` is the smallest id among all documents reachable over links; null ids
    never name a component that has another. ``kept`` marks one text of each component: of
    the least id, then of the least hash of the text (``text_key``); repeated rows of it are
    all marked. Null and empty texts have fingerprint zero and are linked like any other.
    An empty table gives an empty result.
    """
    rows = keep(fingerprints(docs, doc_id, text)).withColumn("salt", salt("doc_id", "text_key"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    # A fingerprint may stand for a third of all rows: these meet by salt, their salts by fingerprint.
    parts = rows.groupBy("fp", "salt").agg(F.min(first).alias("first"))
    classes = keep(parts.groupBy("fp").agg(F.min("first").alias("first")))
    linked = components(links(classes.select("fp"), bits)).withColumnRenamed("node", "fp")
    roots = classes.join(linked, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = with_least(keep(roots), "root", "first", "least", "fp").select("fp", "least")
    return rows.join(parts.select("fp", "salt").join(named, "fp"), ["fp", "salt"]).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))).alias("kept"),
        "text_key",
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each component; its columns as they are."""
    kept = near_duplicates(docs, doc_id, text, bits).where("kept")
    on = unused(docs.columns, "key", "id_or_0", "no_id")
    own = F.col(doc_id).cast("long")
    rows = docs.select("*", *(c.alias(n) for n, c in zip(on, (F.xxhash64(F.col(text)), F.coalesce(own, F.lit(0)), own.isNull()), strict=True)))
    mine = (F.col("text_key"), F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull())
    return rows.join(kept.select(*(c.alias(n) for n, c in zip(on, mine, strict=True))), on, "left_semi").dropDuplicates(on).select(docs.columns)
