"""Text expressions: decoding, tokens, similarity of token sets, figures in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern of a word.
WORD = r"[a-z][a-z'-]*[a-z]|[a-z]"

#: What cp1252 has at 0x80..0x9F; five bytes it leaves undefined keep their code point.
_CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
_C1 = "".join(map(chr, range(0x80, 0xA0)))


def decode_bytes(raw: Column) -> Column:
    """UTF-8 if the bytes are valid, else cp1252."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.translate(F.decode(raw, "ISO-8859-1"), _C1, _CP1252))


def tokens(text: Column) -> Column:
    """Lower-case ASCII words; digits and accented letters split them."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_set(text: Column) -> Column:
    """Distinct runs of ASCII letters, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; NaN where one is empty."""
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(float("nan"))).otherwise(shared)


def paragraphs(text: Column, least: int = 200, most: int = 300) -> Column:
    """The first ``most`` lines of at least ``least`` characters."""
    return F.slice(F.filter(F.split(text, "\n"), lambda p: F.length(p) >= least), 1, most)


def clean_number(x: Column) -> Column:
    """NaN as null; four decimals below ten, whole numbers above, half to even."""
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")).when(F.abs(x) < 10, F.bround(x, 4)).otherwise(F.bround(x, 0))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9.]", "")


def parse_answer(text: Column) -> Column:
    """A figure in dollars out of an answer; null for ``unknown`` or without a number.

    Every scale word within twelve characters after the number multiplies it.
    """
    text = F.lower(F.btrim(text))
    number = F.regexp_extract(text, r"[0-9][0-9,]*(?:\.[0-9]+)?", 0)
    tail = F.substring(F.regexp_extract(text, r"(?s)[0-9][0-9,]*(?:\.[0-9]+)?(.*)$", 1), 1, 12)
    value = F.regexp_replace(number, ",", "").try_cast("double")
    for word, scale in (("billion", 1e9), ("million", 1e6), ("thousand", 1e3)):
        value = F.when(F.contains(tail, F.lit(word)), value * scale).otherwise(value)
    return F.when(F.startswith(text, F.lit("unknown")) | (number == ""), F.lit(None).cast("double")).otherwise(value)


# How prose and tables state revenue.
_FIGURE = (
    r"(?i)(?:total\s+(?:net\s+)?revenues?|net\s+revenues?|total\s+net\s+sales|net\s+sales|revenues?)"
    r"[^$0-9]{0,80}\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(billion|million|thousand)?"
)
_NOTE = r"(?i)in\s+(thousand|million|billion)s"


def extract_revenue(passage: Column) -> Column:
    """The first stated revenue in dollars, scaled by its own word or else the table's note."""
    number = F.regexp_extract(passage, _FIGURE, 1)
    word = F.lower(F.regexp_extract(passage, _FIGURE, 2))
    scale = F.when(word != "", word).otherwise(F.lower(F.regexp_extract(passage, _NOTE, 1)))
    factor = F.when(scale == "billion", 1e9).when(scale == "million", 1e6).when(scale == "thousand", 1e3).otherwise(1.0)
    return F.when(number != "", F.regexp_replace(number, ",", "").try_cast("double") * factor)


def written_forms(usd: Column) -> Column:
    """How a filing may write an amount: in ones, thousands, millions or billions, with up to two decimals."""
    forms = []
    for scale in (1.0, 1e3, 1e6, 1e9):
        scaled = usd / scale
        for decimals in (0, 1, 2):
            forms.append(F.when(scaled >= 1, F.format_number(scaled, decimals)))
    return F.array_distinct(F.array_compact(F.array(*forms)))


def is_answerable(text: Column, usd: Column) -> Column:
    """Whether a number in the text is one of the amount's written forms, separators aside."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), digits_only)
    return F.arrays_overlap(numbers, F.transform(written_forms(usd), digits_only))


def prompt(passage: Column, year_end: Column) -> Column:
    """The question put to a model about a passage, for the fiscal year's end."""
    return F.format_string(
        "These passages come from the discussion section of an annual report for the fiscal year that ended %s. "
        "State the total revenue of that year in US dollars as one whole number, converting thousands or millions. "
        "If they do not say, answer unknown.\n\n%s",
        year_end.cast("string"), passage,
    )


def fit_budget(text: Column, budget: int, size=lambda t: F.size(F.split(t, r"\s+")), factor: float = 0.85, rounds: int = 24) -> Column:
    """The longest of the text's prefixes, each ``factor`` of the last, whose ``size`` is within ``budget``."""
    lengths = F.transform(F.sequence(F.lit(0), F.lit(rounds)), lambda k: F.floor(F.length(text) * F.pow(F.lit(factor), k)).cast("int"))
    fits = F.filter(F.transform(lengths, lambda n: F.left(text, n)), lambda t: size(t) <= budget)
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(""))
