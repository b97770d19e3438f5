"""Raw documents to clean lines, as JVM expressions: decode, drop, split tags, resolve entities."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _CP1252, decode_bytes

# What each tag does, which characters are blank, and what is dropped.
BLOCK_TAGS = (
    "address article aside blockquote br center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p page pre section table tbody thead tfoot title tr ul"
).split()
CELL_TAGS = ("td", "th")
DROPPED = ("script", "style", "head", "ix:header")
ASCII_SPACES, WIDE_SPACES = r" \t\r\f\x0B", r"\u00A0\u2000-\u200A\u202F\u205F\u3000"
SPACES = ASCII_SPACES + WIDE_SPACES
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"

_NAME = "[A-Za-z0-9:_-]"
_ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """What ``then`` makes of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def drop_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def drop_content(html: Column) -> Column:
    """Without the elements that hold no text of the document."""
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?si)<{tag}(?!{_NAME}).*?</{tag}[ \t\r\n]*>", "")
    return html


def _replaced(text: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """All matches replaced by what ``by`` makes of them, in one pass over the text."""
    plain = F.split(text, pattern, -1)
    made = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), by)
    return F.array_join(F.zip_with(plain, made, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


#: What a tag's name stands between until it is replaced: code points that are no characters, for use inside a process.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def _any_of(names: tuple[str, ...]) -> str:
    """A pattern of the names that tries each letter once."""
    heads: dict[str, list[str]] = {}
    for n in names:
        heads.setdefault(n[:1], []).append(n[1:])
    return "(?:" + "|".join(h + (_any_of(tuple(rest)) if any(rest) else "") for h, rest in sorted(heads.items(), reverse=True)) + ")"


def split_tags(html: Column) -> Column:
    """Block tags become line breaks, cells blanks, other tags nothing.

    One pass finds the tags and leaves their names, the next ones replace names of each kind.
    """
    named = F.regexp_replace(html, rf"</?([A-Za-z]{_NAME}*)[^>]*>", rf"{_OPEN}$1{_CLOSE}")
    lines = F.regexp_replace(named, rf"(?i){_OPEN}{_any_of(tuple(BLOCK_TAGS))}{_CLOSE}", "\n")
    cells = F.regexp_replace(lines, rf"(?i){_OPEN}(?:{'|'.join(CELL_TAGS)}){_CLOSE}", " ")
    return F.regexp_replace(cells, f"{_OPEN}[^{_CLOSE}]*{_CLOSE}", "")


def _character(point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")


def _resolved(entity: Column) -> Column:
    body = F.substring(entity, 2, 40)
    body = F.left(body, F.length(body) - 1)
    hexadecimal = F.conv(F.regexp_extract(body, "^#[xX]([0-9a-fA-F]+)$", 1), 16, 10)
    point = F.coalesce(F.when(body.rlike("^#[xX]"), hexadecimal), F.regexp_extract(body, "^#([0-9]+)$", 1)).try_cast("int")
    old = F.array(*map(F.lit, _CP1252))
    numeric = (
        F.when(point.between(128, 159), F.try_element_at(old, point - 127))
        .when((point == 0) | (point > 0x10FFFF) | point.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .otherwise(_character(point))
    )
    names, values = zip(*((n, chr(c)) for n, c in name2codepoint.items()), strict=True)
    named = F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, values))), body)
    return F.when(body.startswith("#"), numeric).otherwise(F.coalesce(named, entity))


def resolve_entities(text: Column) -> Column:
    """Numeric and HTML 4 entities as their characters, in one pass; unknown names stay."""
    return once(text, lambda t: F.when(F.contains(t, F.lit("&")), _replaced(t, _ENTITY, _resolved)).otherwise(t))


def split_lines(text: Column) -> Column:
    """Lines with blanks collapsed, without empty ones."""
    def rare(t: Column, pattern: str, by: str) -> Column:  # most texts have none, and finding that out is cheap
        return once(t, lambda x: F.when(x.rlike(pattern), F.regexp_replace(x, pattern, by)).otherwise(x))

    text = rare(rare(text, f"[{ZERO_WIDTH}]", ""), f"[{WIDE_SPACES}]", " ")
    text = F.regexp_replace(text, f"[{ASCII_SPACES}]{{2,}}|[{ASCII_SPACES}&&[^ ]]", " ")  # a blank by itself stays
    text = F.btrim(F.regexp_replace(text, " ?\n[ \n]*", "\n"), F.lit(" \n"))
    return once(text, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n")))


def to_lines(raw: Column, binary: bool = True) -> Column:
    """All steps; ``raw`` is bytes, or text already."""
    return split_lines(resolve_entities(split_tags(drop_content(drop_comments(decode_bytes(raw) if binary else raw)))))
