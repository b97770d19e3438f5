"""Exact dedup over a cuckoo-filter index of live digests.

Texts are equal when their SHA-256 digests are. Digests are pre-aggregated, then dealt by
digest; each partition keeps one :class:`CuckooIndex`. A filter hit alone decides nothing:
it is verified against the full digests stored in the bucket that was hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, salt, unused


class CuckooIndex:
    """A set of byte-string keys with values: a cuckoo filter in front of bucketed content.

    The filter holds a 16-bit tag of each live key in one of two buckets (partial-key
    cuckoo hashing, four slots each). The content of a bucket is the full keys, with their
    values, whose first bucket it is; ``find`` asks the filter first and then verifies
    against that content, ``delete`` removes both. When an insertion finds no free slot
    within ``MAX_KICKS`` moves, the filter doubles and is rebuilt from the stored keys.
    """

    SLOTS = 4
    MAX_KICKS = 200

    def __init__(self, buckets: int = 1024):
        self.n = 1 << max(1, (buckets - 1).bit_length())
        self.content: dict[int, dict[bytes, list]] = {}
        self.size = 0
        self.resizes = 0
        self._empty()

    def _empty(self) -> None:
        self.tags: list[list[int]] = [[] for _ in range(self.n)]

    def _places(self, key: bytes) -> tuple[int, int, int]:
        """The tag and the two buckets."""
        tag = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & (self.n - 1)
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & (self.n - 1)

    def find(self, key: bytes) -> list | None:
        """The key's value if it is live."""
        tag, a, b = self._places(key)
        if tag not in self.tags[a] and tag not in self.tags[b]:
            return None
        return self.content.get(a, {}).get(key)

    def insert(self, key: bytes, value: list) -> None:
        """Put ``value`` for a key that is not live yet."""
        tag, a, b = self._places(key)
        self.content.setdefault(a, {})[key] = value
        self.size += 1
        if not self._place(tag, a, b):
            self._resize()

    def _place(self, tag: int, a: int, b: int) -> bool:
        for bucket in (a, b):
            if len(self.tags[bucket]) < self.SLOTS:
                self.tags[bucket].append(tag)
                return True
        bucket = a
        for kick in range(self.MAX_KICKS):
            slots = self.tags[bucket]
            slots[kick % self.SLOTS], tag = tag, slots[kick % self.SLOTS]
            bucket = self._other(bucket, tag)
            if len(self.tags[bucket]) < self.SLOTS:
                self.tags[bucket].append(tag)
                return True
        return False

    def _resize(self) -> None:
        keys = [item for held in self.content.values() for item in held.items()]
        while True:
            self.n *= 2
            self.resizes += 1
            self._empty()
            self.content = {}
            if all([self._restore(k, v) for k, v in keys]):
                return

    def _restore(self, key: bytes, value: list) -> bool:
        tag, a, b = self._places(key)
        self.content.setdefault(a, {})[key] = value
        return self._place(tag, a, b)

    def delete(self, key: bytes) -> bool:
        """Remove a live key; false if there was none."""
        tag, a, b = self._places(key)
        if self.find(key) is None:
            return False
        del self.content[a][key]
        self.size -= 1
        self.tags[a if tag in self.tags[a] else b].remove(tag)
        return True

    def items(self) -> Iterator[tuple[bytes, list]]:
        for held in self.content.values():
            yield from held.items()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feed the partial groups and withdrawals of a partition to one index; emit what is live, once for each of its salts."""
    index = CuckooIndex()
    withdrawn = []
    for batch in batches:
        for digest, own, top, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "salt", "keep_id", "group_size")), strict=True):
            if n < 0:
                withdrawn.append(digest)
            elif (live := index.find(digest)) is None:
                index.insert(digest, [top, n, 1 << own])
            else:
                live[0] = top if live[0] is None or (top is not None and top > live[0]) else live[0]
                live[1] += n
                live[2] |= 1 << own
    for digest in withdrawn:
        index.delete(digest)
    out: list[tuple] = []
    for digest, (top, n, salts) in index.items():
        out += [(digest, k, top, n) for k in range(salts.bit_length()) if salts >> k & 1] if salts & (salts - 1) else [(digest, salts.bit_length() - 1, top, n)]
        if len(out) >= 10_000:
            yield _live(out)
            out = []
    if out:
        yield _live(out)


def _live(rows: list[tuple]) -> pa.RecordBatch:
    types = {"digest": pa.binary(), "salt": pa.int64(), "keep_id": pa.int64(), "group_size": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


def digest_of(text: str = "text") -> Column:
    """SHA-256 of the text's UTF-8; a null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def keepers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", withdrawn: DataFrame | None = None) -> DataFrame:
    """``digest, salt, keep_id, group_size`` of each distinct text, once for each salt among its ids.

    ``keep_id`` is the largest id (null if all are). ``withdrawn`` is an optional table with
    a ``digest`` column: those digests are deleted from the index and so have no row. Rows
    of one digest are summed by the salts of their ids before they meet, so that a text held
    by a third of all rows sends no more than SALTS rows to its partition; and it gets as
    many rows back, so that what is joined by digest and salt is spread in the same way.
    """
    rows = docs.select(digest_of(text).alias("digest"), F.col(doc_id).cast("long").alias("id"))
    parts = rows.groupBy("digest", salt("id").alias("salt")).agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    if withdrawn is not None:
        gone = (F.lit(0).cast("long").alias("salt"), F.lit(None).cast("long").alias("keep_id"), F.lit(-1).cast("long").alias("group_size"))
        parts = parts.unionByName(withdrawn.select("digest", *gone))
    return parts.repartition("digest").mapInArrow(_index, "digest binary, salt long, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest ``doc_id`` stays; among repeated rows with that
    same id exactly one does. Null texts count as empty. Null ids lose to any other; a
    group of null ids only keeps one row, with a null ``keep_id``. An empty table gives an
    empty result. Other columns of ``docs`` do not matter.
    """
    rows = docs.select(digest_of(text).alias("digest"), F.col(doc_id).cast("long").alias("doc_id"))
    rows = rows.groupBy("digest", "doc_id", salt("doc_id").alias("salt")).agg(F.count("*").alias("copies"))
    out = rows.join(keepers(docs, doc_id, text), ["digest", "salt"])
    return out.select(
        "doc_id", "keep_id", "group_size", "digest",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` does not keep; its columns as they are."""
    on = unused(docs.columns, "digest", "id_or_0", "no_id")
    key = (F.coalesce(F.col("keep_id"), F.lit(0)), F.col("keep_id").isNull())
    keep = keepers(docs, doc_id, text).where(F.col("salt") == salt("keep_id"))
    keep = keep.select(F.col("digest").alias(on[0]), *(c.alias(n) for n, c in zip(on[1:], key, strict=True)))
    own = F.col(doc_id).cast("long")
    rows = docs.select("*", *(c.alias(n) for n, c in zip(on, (digest_of(text), F.coalesce(own, F.lit(0)), own.isNull()), strict=True)))
    return rows.join(keep, on, "left_semi").dropDuplicates(on).select(docs.columns)
