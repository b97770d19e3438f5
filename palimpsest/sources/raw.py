"""Raw documents as files: reading them back, and what is already landed."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unpacked(raw: bytes) -> bytes:
    """Gunzipped if it is gzip."""
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):  # one document at a time: they may be large
            row = batch.slice(k, 1)
            content = row.column("content")[0].as_py()
            yield pa.RecordBatch.from_arrays([row.column("path"), pa.array([None if content is None else unpacked(content)], pa.binary())], names=["path", "raw"])


def read(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, raw`` of all files below ``path``, gunzipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(_unpack, "path string, raw binary")


def unpack(docs: DataFrame, column: str = "raw") -> DataFrame:
    """``docs`` with the bytes of ``column`` gunzipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                content = row.column(column)[0].as_py()
                made = pa.array([None if content is None else unpacked(content)], pa.binary())
                yield pa.RecordBatch.from_arrays([made if c == column else row.column(c) for c in batch.schema.names], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def described(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """``docs`` with ``bytes_raw`` and ``sha256`` of the bytes."""
    return docs.withColumns({"bytes_raw": F.length(raw).cast("long"), "sha256": F.sha2(raw, 256)})


def not_landed(wanted: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """What a read-through cache would still have to fetch."""
    return wanted.join(landed.select(*keys).distinct(), keys, "left_anti")
