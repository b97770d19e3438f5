"""Filing headers: when a filing was accepted, and for which period."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.times import from_local


def accepted_at(text: Column) -> Column:
    """Fourteen digits of Eastern time after the acceptance tag, as UTC."""
    return from_local(F.regexp_extract(text, r"ACCEPTANCE-DATETIME>\s*([0-9]{14})", 1))


def period(text: Column) -> Column:
    """The period of report, in either of the two header styles."""
    digits = F.regexp_extract(text, r"(?:<PERIOD>|CONFORMED PERIOD OF REPORT:)\s*([0-9]{8})", 1)
    return F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")
