"""The ticker a report states for itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import to_lines

# Where a ticker stands, and capitals that are none.
_TAG = r'(?U)name="dei:TradingSymbol"[^>]*>(?:\s*<[^>]+>)*\s*([A-Za-z][A-Za-z.\-]{0,7})'
_SYMBOL = (
    r"(?U)(?:under\s+the\s+(?:ticker\s+|trading\s+)?symbols?|ticker\s+symbols?|trading\s+symbols?|symbol)"
    r"\s*[:\"“'‘(]*\s*([A-Z]{1,5}(?:[.\-][A-Z]{1,2})?)\b"
)
NOT_TICKERS = ("A", "I", "THE", "OUR", "NYSE", "OTC", "OTCBB", "OTCQB", "OTCQX", "USD", "AMEX", "NASDAQ", "MKT", "LLC", "INC", "CORP", "CO", "AND", "OF", "IS", "ON", "PINK", "QB")


def mentioned(text: Column) -> Column:
    """Symbols in order of mention, repeats included."""
    found = F.regexp_extract_all(text, F.lit(_SYMBOL), F.lit(1))
    return F.filter(found, lambda s: ~s.isin(*NOT_TICKERS))


def most_frequent(items: Column) -> Column:
    """The most frequent element, of equals the first."""
    scored = F.transform(F.array_distinct(items), lambda x, i: F.struct(F.size(F.filter(items, lambda y: y == x)).alias("n"), (-i).alias("order"), x.alias("x")))
    return F.array_max(scored)["x"]


def ticker_map(docs: DataFrame, raw: str = "raw", keys: list[str] | None = None, held: DataFrame | None = None) -> DataFrame:
    """``ticker, source, candidates`` of each document not yet in ``held``: its tag, else the symbol it mentions most."""
    keys = keys or [c for c in docs.columns if c != raw]
    todo = docs if held is None else docs.join(held.select(*keys).distinct(), keys, "left_anti")
    text = F.translate(F.make_valid_utf8(F.col(raw).cast("string")), "\ufffd", "")  # bytes that are not UTF-8 are left out
    tag = F.upper(F.regexp_extract(text, _TAG, 1))
    read = todo.select(*keys, tag.alias("tag"), F.explode(F.array(mentioned(F.array_join(to_lines(F.col(raw)), " ")))).alias("found"))
    ticker = F.when(F.col("tag") != "", F.col("tag")).otherwise(most_frequent(F.col("found")))
    source = F.when(F.col("tag") != "", "xbrl_tag").when(F.size("found") > 0, "item5_text")
    return read.select(*keys, ticker.alias("ticker"), source.alias("source"), F.array_distinct("found").alias("candidates"))
