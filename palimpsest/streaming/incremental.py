"""Incremental processing: documents are parsed as they land, and late versions never overwrite.

The landing folder is a stream of files with a checkpoint, so a crash is resumed by running
again. Each micro-batch is upserted by key; a document that cannot be parsed goes to a table
of failures and is not tried again by this parser version, and the others of its batch are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import sinks
from ..operators import sections
from ..session import keep


def parse_landing(
    spark: SparkSession, landing: str, out: str, checkpoint: str, failures: str | None = None, version: int = sections.PARSER_VERSION,
    parse: Callable[[DataFrame], DataFrame] = lambda docs: sections.parse(docs, keys=["accession"]),
) -> StreamingQuery:
    """Parse every Parquet row ``accession, raw`` that landed since the last run, then stop.

    The checkpoint is per parser version: a new version reads everything again. Documents
    with no bytes, or that the parser fails on, go to ``failures`` with the error.
    """
    stream = spark.readStream.schema("accession string, raw binary").parquet(landing)

    def batch(docs: DataFrame, _: int) -> None:
        sound = docs.where("raw is not null and length(raw) > 0").dropDuplicates(["accession"])
        if sinks.exists(spark, out):
            sound = sections.unparsed(sound, sinks.read_table(spark, out), ["accession"], version)
        bad = docs.where("raw is null or length(raw) = 0").select("accession", F.lit("empty").alias("error"))
        errors = parsed(keep(sound), 0)
        if failures:
            broken = spark.createDataFrame(errors, "accession string, error string")
            sinks.upsert_table(bad.unionByName(broken), failures, ["accession"])
        elif errors:
            raise ValueError(f"{errors[0][0]}: {errors[0][1]}")

    def parsed(docs: DataFrame, depth: int) -> list[tuple[str, str]]:
        """Upsert what can be parsed; where something fails, each half is tried by itself down to the document."""
        try:
            sinks.upsert_table(parse(docs), out, ["accession", "section"])
            return []
        except Exception as e:  # noqa: BLE001
            names = [r[0] for r in docs.select("accession").limit(2).collect()]
            if len(names) < 2:
                return [(names[0], str(e).strip().split("\n")[0][:500])] if names else []
            side = F.getbit(F.xxhash64("accession"), F.lit(depth))
            return [x for k in (0, 1) for x in parsed(docs.where(side == k), depth + 1)]

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/v{version}").trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, table: str, keys: list[str], checkpoint: str, order: list[str] | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Upsert what a stream brings, batch by batch, into the table at ``table``."""

    def batch(rows: DataFrame, _: int) -> None:
        sinks.upsert_table(prepare(rows), table, keys, order)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
