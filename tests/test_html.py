import html.entities
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import html as h
from palimpsest.operators import sections
from palimpsest.operators.tickers import ticker_map

BODY = "<p>" + "We face many risks. " * 100 + "</p>"


def lines_of(spark, *raws):
    rows = spark.createDataFrame([(i, bytearray(r if isinstance(r, bytes) else r.encode())) for i, r in enumerate(raws)], "i long, raw binary")
    return [r.x for r in rows.orderBy("i").select(h.to_lines(F.col("raw")).alias("x")).collect()]


def plain(raw):
    """The rules once more, character by character where they can be."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)
    while "<!--" in text and "-->" in text[text.index("<!--") + 4 :]:
        a = text.index("<!--")
        text = text[:a] + text[text.index("-->", a + 4) + 3 :]
    for tag in ("script", "style", "head", "ix:header"):
        text = re.sub(rf"<{tag}(?![\w:-]).*?</{tag}\s*>", "", text, flags=re.S | re.I | re.A)
    out, i = "", 0
    while i < len(text):
        m = re.compile(r"</?([A-Za-z][A-Za-z0-9:_-]*)[^>]*>").match(text, i)
        if m:
            name = m[1].lower()
            out += "\n" if name in h.BLOCK_TAGS else " " if name in h.CELL_TAGS else ""
            i = m.end()
        else:
            out += text[i]
            i += 1

    def entity(m):
        e = m[1]
        if e[0] != "#":
            return chr(html.entities.name2codepoint[e]) if e in html.entities.name2codepoint else m[0]
        n = int(e[2:], 16) if e[1] in "xX" else int(e[1:])
        if 128 <= n <= 159:
            return bytes([n]).decode("cp1252", "ignore") or chr(n)
        return "�" if n == 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)

    out = re.sub(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", entity, out)
    blanks = " \t\r\f\v\xa0  　" + "".join(map(chr, range(0x2000, 0x200B)))
    out = out.translate({ord(c): None for c in "​‌‍﻿"})
    lines = ["".join(" " if c in blanks else c for c in line) for line in out.split("\n")]
    return [x for x in (re.sub(" +", " ", line).strip(" ") for line in lines) if x]


def test_lines_against_a_plain_version(spark):
    draw = random.Random(8)
    bits = ["<p>", "</P>", "<td>", "<div class='a'>", "<b>", "</b>", "<script>x</script>", "<scripty>", "<head>h</head >", "<!-- c -->", "<!--", "-->", "a", "Bc", " ", "\n", "\t", "\xa0", " ", "​", "&amp;", "&lt;", "&#65;", "&#x41;", "&#150;", "&#0;", "&#xD800;", "&#1114112;", "&#128512;", "&nope;", "&amp;lt;", "&eacute;", "<", ">", "é", "<br/>", "<pre", "<x:y-z>", "<ix:header>q</ix:header>", "1"]
    raws = ["".join(draw.choices(bits, k=draw.randint(0, 40))).encode() for _ in range(600)]
    raws += [r.decode().encode("latin-1", "ignore") + b"\x93\x81\xff" for r in raws[:100]]
    for raw, got in zip(raws, lines_of(spark, *raws), strict=True):
        assert got == plain(raw), raw


def locate(spark, raw):
    df = spark.createDataFrame([("a", bytearray(raw.encode()))], "accession string, raw binary")
    return {r.section: r for r in sections.parse(df, keys=["accession"]).collect()}


@pytest.mark.parametrize(
    ("raw", "status"),
    [
        (f"<p>Item 1A. Risk Factors</p><p>Item 2. Properties</p><h1>Item 1A. Risk Factors</h1>{BODY}<h1>Item 2. Properties</h1>", "found"),
        (f"<p>see Item 1A for more</p>{BODY}<p>Item 2. Properties</p>", "not_found"),
        (f"<p>1A. Risk Factors</p>{BODY}<p>2. Properties</p>", "found"),
        (f"<p>1A. We may fail</p>{BODY}<p>2. Properties</p>", "not_found"),
        ("<p>Item 1A. Risk Factors</p><p>Not required for smaller reporting companies.</p><p>Item 2.</p>", "omitted"),
        ("<p>Item 1A. Risk Factors</p><p>Incorporated herein by reference.</p><p>Item 2.</p>", "by_reference"),
        ("<p>Item 1A. Risk Factors</p><p>Short.</p><p>Item 2.</p>", "too_short"),
        (f"<p>Item 1A. Risk Factors</p>{BODY}", "unterminated"),
        (f"<p>PART I — ITEM 01A &#8211; Risk</p>{BODY}<p>Items 1. Business</p><p>item 1b</p>", "found"),
    ],
)
def test_section_status(spark, raw, status):
    row = locate(spark, raw)["risk_factors"]
    assert row.status == status and (row.text is not None) == (status == "found")


def test_body_beats_contents_and_7_a_ends_7(spark):
    row = locate(spark, f"<p>Item 7. MD&amp;A</p><p>Item 8.</p><p>Item 7. Management</p>{BODY}<p>Item 7.A Market risk</p>{BODY}<p>Item 8.</p>")["mdna"]
    assert row.status == "found" and (row.start_line, row.end_line) == (2, 4) and row.text.startswith("We face")


def test_only_unparsed_documents(spark):
    docs = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "accession string, raw binary")
    parsed = spark.createDataFrame([("a", 1), ("b", 0)], "accession string, parser_version int")
    assert [r.accession for r in sections.unparsed(docs, parsed, ["accession"]).collect()] == ["b"]
    assert sections.parse(docs.limit(0), keys=["accession"]).count() == 0


def test_tickers(spark):
    raws = [b'<a name="dei:TradingSymbol" x> <b>\n abc.d</b>', b"<p>under the symbol &#8220;XY&#8221;; ticker symbol: ZZ; trading symbol ZZ</p>", b"<p>symbol NYSE</p>"]
    docs = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "accession long, raw binary")
    got = {r.accession: (r.ticker, r.source, r.candidates) for r in ticker_map(docs).collect()}
    assert got == {0: ("ABC.D", "xbrl_tag", []), 1: ("ZZ", "item5_text", ["XY", "ZZ"]), 2: (None, None, [])}
