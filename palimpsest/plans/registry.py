"""All registered queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from . import files, findings, landing, markets, models, outputs, texts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "section_changes"
#: What the findings report prints, in this order.
REPORT = (
    "universe_sample", "coverage", "timing", "share_of_total", "session_flips", "api_clock_check", "amendments", "period_disagreement", "storage", "outcome_share", "change_summary", "event_auc",
)
for module in (findings, texts, markets, models, files, outputs, landing):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL


def report(spark: SparkSession, sf_dir: str, names: Iterable[str] = REPORT, rows: int = 20, out: Callable[[str], None] = print) -> None:
    """Print the named queries' results one after another, each under its name; a query whose tables are absent is left out."""
    for name in names:
        if name not in QUERIES:
            raise KeyError(f"no query is named {name}")
        try:
            found = QUERIES[name](spark, sf_dir)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out(f"\n== {name}\n{found.limit(rows).toPandas().to_string(index=False)}")
