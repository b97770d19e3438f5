"""Numbers as the viewer writes them, as column expressions. What is missing or not finite is a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def fixed(x: Column, digits: int) -> Column:
    """With so many digits after the point, halves away from zero; what is negative keeps its sign, as zero too.

    What counts is the double times ten to the ``digits``, as in the SQL and nearly as in the
    viewer: 1.005 is below its half, so it is 1.00 and not, as its decimal form would be, 1.01.
    """
    size, by = F.abs(x).cast("double"), 10.0**digits
    whole = F.rint(size * by)  # halves to even, so some of them are one short
    near = (whole + F.when(size * by - whole == 0.5, 1.0).otherwise(0.0)) / by
    return F.concat(F.when(x < 0, "-").otherwise(""), F.format_string(f"%.{digits}f", F.when(size * by == float("inf"), size).otherwise(near)))


def _known(x: Column, shown: Column) -> Column:
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(finite, shown).otherwise(DASH)


def money(usd: Column) -> Column:
    """Dollars in billions, millions, thousands or whole."""
    size = F.abs(usd)
    shown = (
        F.when(size >= 1e10, F.concat(fixed(size / 1e9, 1), F.lit("B"))).when(size >= 1e9, F.concat(fixed(size / 1e9, 2), F.lit("B")))
        .when(size >= 1e7, F.concat(fixed(size / 1e6, 0), F.lit("M"))).when(size >= 1e6, F.concat(fixed(size / 1e6, 1), F.lit("M")))
        .when(size >= 1e3, F.concat(fixed(size / 1e3, 0), F.lit("K"))).otherwise(fixed(size, 0))
    )
    return _known(usd, F.concat(F.when(usd < 0, "-").otherwise(""), F.lit("$"), shown))


def pct(x: Column, digits: int = 1) -> Column:
    return _known(x, F.concat(fixed(x * 100, digits), F.lit("%")))


def num(x: Column, digits: int = 3) -> Column:
    return _known(x, fixed(x, digits))


def interval(low: Column, high: Column, digits: int = 3) -> Column:
    """Both ends in brackets; empty without them."""
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("["), fixed(low, digits), F.lit(", "), fixed(high, digits), F.lit("]"))).otherwise("")


def significant(low: Column, high: Column) -> Column:
    """Whether an interval leaves zero out."""
    return F.coalesce((low > 0) | (high < 0), F.lit(False))


def revenue_matches(found: Column, stated: Column, within: float = 0.005) -> Column:
    """Whether a figure is the stated one but for ``within`` of it."""
    return F.coalesce((stated > 0) & (F.abs(found - stated) <= within * stated), F.lit(False))


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text
