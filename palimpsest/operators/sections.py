"""Locating the sections of a report in its lines, with array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import to_lines

PARSER_VERSION = 1

# Items in their order, the studied sections, headings and their standard titles.
ITEMS = ("1", "1A", "1B", "1C", "2", "3", "4", "5", "6", "7", "7A", "8", "9", "9A", "9B", "9C", "10", "11", "12", "13", "14", "15", "16")
SECTIONS = {"risk_factors": "1A", "mdna": "7"}
LONGEST_HEADING, SHORTEST_BODY = 200, 1000
_ITEM = r"([0-9]{1,2})(?:\.?([a-cA-C]))?(?![A-Za-z0-9])"
_MARK = r"[.:\-\u2013\u2014]"
_HEADING = rf"(?iu)^(?:part +i{{1,3}} *[,.:\-\u2013\u2014]? *)?items? *{_ITEM}"
_BARE = rf"(?s)^{_ITEM} *{_MARK}? *(.*)$"
TITLES = {
    "1": "business", "1A": "risk factors", "1B": "unresolved staff", "1C": "cybersecurity", "2": "(?:description of )?propert",
    "3": "legal proceedings", "4": r"mine safety|submission of matters|\(?removed and reserved|reserved", "5": "market for",
    "6": r"selected (?:consolidated )?financial|\[?reserved", "7": "management.{0,3}s discussion", "7A": "quantitative and qualitative",
    "8": "(?:consolidated )?financial statements", "9": "changes in and disagreements", "9A": "controls and procedures",
    "9B": "other information", "9C": "disclosure regarding foreign", "10": "directors", "11": "executive compensation",
    "12": "security ownership", "13": "certain relationships", "14": "principal account", "15": "exhibits", "16": "form 10-k summary",
}
_OMITTED = r"(?iu)not[ \n]+(?:required|applicable)|smaller[ \n]+reporting[ \n]+compan|omitted"
_BY_REFERENCE = r"(?iu)incorporated[ \n]+(?:herein[ \n]+)?by[ \n]+reference"


def _item(line: Column, pattern: str) -> Column:
    number = F.ltrim(F.regexp_extract(line, pattern, 1), F.lit("0"))
    return F.concat(number, F.upper(F.regexp_extract(line, pattern, 2)))


def _rank(item: Column) -> Column:
    """Place in the standard order, from 1; 0 for an unknown item."""
    return F.array_position(F.array(*map(F.lit, ITEMS)), item)


def _heading_item(line: Column) -> Column:
    """The item a line is the heading of, else null. A line that names an item is judged by that alone."""
    named, bare = _item(line, _HEADING), _item(line, _BARE)
    rest = F.regexp_extract(line, _BARE, 3)
    titled = F.lit(False)
    for item, title in TITLES.items():
        titled = titled | ((bare == item) & rest.rlike(f"(?iu)^(?:{title.replace(' ', '[ \\n]+')})"))
    return F.when(F.length(line) > LONGEST_HEADING, F.lit(None).cast("string")).when(line.rlike(_HEADING), F.when(_rank(named) > 0, named)).when(titled, bare)


def headings(lines: Column) -> Column:
    """``line`` (from 0), ``item`` and ``rank`` of each heading, in order."""
    first = r"^[pPiI0-9\u0130\u0131]"
    found = F.transform(lines, lambda line, i: F.struct(i.alias("line"), F.when(line.rlike(first), _heading_item(line)).alias("item")))
    known = F.filter(found, lambda h: h["item"].isNotNull())
    return F.transform(known, lambda h: F.struct(h["line"].alias("line"), h["item"].alias("item"), _rank(h["item"]).alias("rank")))


def _body(lines: Column, start: Column, end: Column) -> Column:
    return F.slice(lines, start + 2, F.greatest(end - start - 1, F.lit(0)))


def locate(lines: Column, found: Column, item: str) -> Column:
    """``status, start_line, end_line, text`` of an item: the longest stretch from one of its
    headings to the next heading of a later item, the first of equals."""
    rank = ITEMS.index(item) + 1
    own = F.filter(found, lambda h: h["item"] == item)

    def stretch(h: Column) -> Column:
        end = F.try_element_at(F.filter(found, lambda g: (g["line"] > h["line"]) & (g["rank"] > rank)), F.lit(1))["line"]
        size = F.aggregate(_body(lines, h["line"], end), F.lit(0), lambda n, line: n + F.length(line))
        return F.struct(F.when(end.isNull(), -1).otherwise(size).alias("size"), (-h["line"]).alias("order"), end.alias("end"))

    best = F.array_max(F.transform(own, stretch))
    start, end = -best["order"], best["end"]
    body = F.array_join(_body(lines, start, end), "\n")
    short = (
        F.when(F.concat(F.try_element_at(lines, start + 1), F.lit(" "), body).rlike(_OMITTED), "omitted")
        .when(body.rlike(_BY_REFERENCE), "by_reference").otherwise("too_short")
    )
    status = F.when(best.isNull(), "not_found").when(end.isNull(), "unterminated").when(F.length(body) < SHORTEST_BODY, short).otherwise("found")
    return F.struct(status.alias("status"), start.alias("start_line"), end.alias("end_line"), F.coalesce(body, F.lit("")).alias("text"))


def parse(docs: DataFrame, raw: str = "raw", keys: list[str] | None = None, binary: bool = True) -> DataFrame:
    """One row per document and section: ``parser_version, n_lines, n_chars, section, status,
    start_line, end_line, text``; the text is null unless found."""
    keys = keys or [c for c in docs.columns if c != raw]
    once = lambda df, name, value: df.select("*", F.explode(F.array(value)).alias(name))  # noqa: E731  a step that is computed once
    lined = once(docs.select(*keys, raw), "lines", to_lines(F.col(raw), binary)).drop(raw)
    headed = once(lined, "found", headings(F.col("lines")))
    parts = F.array(*(F.struct(F.lit(n).alias("section"), locate(F.col("lines"), F.col("found"), item).alias("part")) for n, item in SECTIONS.items()))
    rows = headed.select(
        *keys, F.lit(PARSER_VERSION).alias("parser_version"), F.size("lines").alias("n_lines"),
        F.aggregate("lines", F.lit(0), lambda n, line: n + F.length(line)).alias("n_chars"), F.inline(parts),
    )
    return rows.select(
        *keys, "parser_version", "n_lines", "n_chars", "section", "part.status", "part.start_line", "part.end_line",
        F.when(F.col("part.status") == "found", F.col("part.text")).alias("text"),
    )


def unparsed(docs: DataFrame, parsed: DataFrame, keys: list[str], version: int = PARSER_VERSION) -> DataFrame:
    """Documents without rows of this parser version."""
    return docs.join(parsed.where(F.col("parser_version") == version).select(*keys).distinct(), keys, "left_anti")
