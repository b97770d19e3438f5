"""What several of the operators need: columns, the shared folder, row identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder, keep  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, which the cluster names in ``spark.checkpoint.dir``.

    A session on one machine without one (a test) gets a temporary folder.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or checkpoint_folder(spark)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's file systems have it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fold(doc_id: str = "doc_id") -> Column:
    """The document's remainder, 0 to 3; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4))


#: Rows of one key are dealt to so many groups.
SALTS = 256


def salt(*of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(SALTS))


def with_least(rows: DataFrame, key: str, value: str, name: str, *spread: str) -> DataFrame:
    """``rows`` with the least ``value`` of their key as ``name``.

    Rows of one key are told apart by the columns ``spread``. They meet in SALTS groups, and
    only what these groups have found meets by key alone.
    """
    salted = rows.withColumn("__salt", salt(*spread))
    parts = salted.groupBy(key, "__salt").agg(F.min(value).alias(name))
    least = parts.groupBy(key).agg(F.min(name).alias(name))
    return salted.join(parts.select(key, "__salt").join(least, key), [key, "__salt"]).drop("__salt")


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from ``columns`` (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


HELD_OUT = 2


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id) == HELD_OUT
