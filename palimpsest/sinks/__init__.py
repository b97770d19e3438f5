"""Writing results: whole tables, upserted tables, JSON by firm, packed raw documents, and the run log."""

from __future__ import annotations

import gzip
import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.upsert import keep_last, upsert
from ..session import keep


class AlreadyRun(Exception):
    """The result exists and is not to be made twice."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def write(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    """Parquet with zstd, optionally partitioned; the committer publishes it whole."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_once(df: DataFrame, path: str, force: bool = False) -> None:
    """As :func:`write`, but not where a result is already."""
    if not force and exists(df.sparkSession, path):
        raise AlreadyRun(path)
    write(df, path)


#: Parts of a new table that is upserted by key.
PARTS = 16


def upsert_table(new: DataFrame, path: str, keys: list[str], order: list[str] | None = None, parts: int = PARTS) -> int:
    """Upsert ``new`` into the table at ``path`` and return its number of rows; nothing happens for none.

    Rows are dealt to ``parts`` folders by a hash of the keys, and only folders that ``new``
    touches are written again, beside the old ones. A manifest then names the table's folders;
    it appears whole under the next number, so readers (:func:`read_table`) see the table
    before or after, and of two writers at once one fails. What the manifest before the last
    named alone is removed. ``order`` picks among rows of ``new`` with one key.
    """
    spark = new.sparkSession
    number, held = _manifest(spark, path)
    parts = held.get("parts", parts)
    rows = keep_last(new, keys, order) if order else new.dropDuplicates(keys)
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).alias("part")
    rows = keep(rows.select("*", part.alias("__part")))
    touched = {r[0]: r[1] for r in rows.groupBy("__part").count().collect()}  # no more than there are parts
    if not touched:
        return 0
    folders = held.get("folders", {})
    old = [f"{path}/{folders[str(k)]}" for k in touched if str(k) in folders]
    state = upsert(spark.read.parquet(*old), rows.drop("__part"), keys) if old else rows.drop("__part")
    batch = f"batch-{number + 1:06d}-{uuid.uuid4().hex}"
    write(state.withColumn("__part", part).repartition("__part"), f"{path}/{batch}", by=["__part"])
    now = folders | {str(k): f"{batch}/__part={k}" for k in touched}
    _publish(spark, path, number + 1, {"parts": parts, "folders": now, "before": sorted(set(folders.values()) - set(now.values()))})
    for folder in held.get("before", []):
        target, fs = _path(spark, f"{path}/{folder}")
        fs.delete(target, True)
    return sum(touched.values())


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` as its last manifest has it; without one, all of its files."""
    _, held = _manifest(spark, path)
    return spark.read.parquet(*(f"{path}/{f}" for f in held["folders"].values())) if held else spark.read.parquet(path)


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the last manifest; 0 and nothing if there is none."""
    folder, fs = _path(spark, f"{path}/_manifests")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    last = max((n for n in names if n.isdigit()), default=None)
    if last is None:
        return 0, {}
    return int(last), json.loads(spark.read.text(f"{path}/_manifests/{last}", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, number: int, held: dict) -> None:
    """Write a manifest and move it to its number, which no other may have."""
    staged, fs = _path(spark, f"{path}/_manifests/.{uuid.uuid4().hex}")
    out = fs.create(staged)
    out.write(bytearray(json.dumps(held).encode()))
    out.close()
    target = _path(spark, f"{path}/_manifests/{number:012d}")[0]
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, False)
        raise OSError(f"{path} was written by another at the same time")
    fs.delete(_path(spark, f"{path}/_manifests/{number - 2:012d}")[0], False)


def write_json(records: DataFrame, path: str, partitions: int | None = None) -> None:
    """One JSON line per record, nulls left out, gzipped."""
    (records.repartition(partitions) if partitions else records).write.mode("overwrite").option("compression", "gzip").json(path)


def write_by_key(records: DataFrame, path: str, key: str) -> None:
    """A folder for each key with its records as one JSON file, for readers that fetch one key; nulls left out.

    A key's records meet in one task, which is meant for a record or few per key. On a file
    system that is mounted, the tasks write the files themselves, each moved to its name when it
    is whole: Spark's writer takes several ms a file there, and its committer moves them one by one.
    ``_SUCCESS`` tells that all are there. Elsewhere Spark's writer makes the same folders.
    """
    folder = _mounted(records.sparkSession, path)
    if folder is None:
        return records.withColumn("key", F.col(key)).repartition("key").write.mode("overwrite").partitionBy("key").json(path)
    target, fs = _path(records.sparkSession, path)
    fs.delete(target, True)
    os.makedirs(folder)
    name = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    lines = records.select(name.alias("key"), F.to_json(F.struct(*records.columns)).alias("line")).repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch["key"].to_pylist(), batch["line"].to_pylist(), strict=True))
        n = 0
        for n, (k, own) in enumerate(groupby(rows, key=itemgetter(0)), 1):
            at = f"{folder}/key={_escaped(k)}"
            os.makedirs(at, exist_ok=True)
            part = f"{at}/.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8") as f:
                f.writelines(line + "\n" for _, line in own)
            os.replace(part, f"{at}/part-0.json")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    lines.mapInArrow(run, "n long").agg(F.sum("n")).collect()  # one row
    open(f"{folder}/_SUCCESS", "w").close()


def read_by_key(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The records of all files that :func:`write_by_key` made.

    On a mounted file system the folder is listed by one task and the files are read by many;
    the driver holds none of their names, as Spark's reader would.
    """
    folder = _mounted(spark, path)
    if folder is None:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)

    def listed(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with os.scandir(folder) as found:
            names = (e.name for e in found if e.name.startswith("key="))
            while some := list(islice(names, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["name"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in range(0, batch.num_rows, 100):
                lines = []
                for name in batch["name"].slice(some, 100).to_pylist():
                    with open(f"{folder}/{name}/part-0.json", encoding="utf-8") as f:
                        lines += f.read().removesuffix("\n").split("\n")
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])

    names = spark.range(0, 1, 1, 1).mapInArrow(listed, "name string").repartition(4 * spark.sparkContext.defaultParallelism, "name")
    return names.mapInArrow(read, "line string").select(F.from_json("line", schema).alias("r")).select("r.*")


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder as every process of the cluster sees it, if ``path`` is on a mounted file system."""
    p, fs = _path(spark, path)
    uri = fs.makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _escaped(value: str) -> str:
    """As Spark names the folder of a partition's value."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in value)


def pack(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """``docs`` with ``packed`` (gzip) in place of the bytes, and ``bytes_raw``, ``bytes_stored`` and ``sha256``; null stays null."""
    names = [c for c in docs.columns if c not in (raw, "packed", "bytes_raw", "bytes_stored", "sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one document at a time: they may be large
                row = batch.slice(k, 1)
                content = row.column("__raw")[0].as_py()
                packed = None if content is None else gzip.compress(content, 6, mtime=0)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in names), pa.array([packed], pa.binary())], names=[*names, "packed"])

    size = docs.select(*names, F.col(raw).cast("binary").alias("__raw"), F.length(F.col(raw).cast("binary")).cast("long").alias("bytes_raw"), F.sha2(F.col(raw).cast("binary"), 256).alias("sha256"))
    names += ["bytes_raw", "sha256"]
    schema = size.select(*names, F.lit(None).cast("binary").alias("packed")).schema
    out = size.mapInArrow(run, schema)
    return out.withColumn("bytes_stored", F.length("packed").cast("long"))


@contextmanager
def logged_run(spark: SparkSession, path: str, params: str = "{}"):
    """A row in the run log, ``running`` until the block ends and then ``ok`` or ``failed``; yields a dict for its counters."""
    run, counters = uuid.uuid4().hex, {"requests": 0, "retries": 0, "bytes": 0}
    begun = spark.range(1).select(F.current_timestamp()).first()[0]
    schema = "run_id string, started_at timestamp, finished_at timestamp, params string, requests bigint, retries bigint, bytes bigint, status string"

    def put(status: str) -> None:
        row = (run, begun, None, params, counters["requests"], counters["retries"], counters["bytes"], status)
        df = spark.createDataFrame([row], schema)
        upsert_table(df.withColumn("finished_at", F.current_timestamp()) if status != "running" else df, path, ["run_id"])

    put("running")
    try:
        yield counters
    except BaseException:
        put("failed")
        raise
    put("ok")
