"""Where the archive keeps what."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The archive's addresses.
ARCHIVE = "https://www.sec.gov/Archives/edgar"
DATA = "https://data.sec.gov"


def _padded(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def index(year: Column, quarter: Column) -> Column:
    return F.format_string(f"{ARCHIVE}/full-index/%d/QTR%d/master.idx", year, quarter)


def submissions(cik: Column, page: Column | None = None) -> Column:
    own = F.concat(F.lit(f"{DATA}/submissions/CIK"), _padded(cik), F.lit(".json"))
    return own if page is None else F.coalesce(F.concat(F.lit(f"{DATA}/submissions/"), page), own)


def folder(cik: Column, accession: Column) -> Column:
    return F.concat(F.lit(f"{ARCHIVE}/data/"), cik.cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")))


def header(cik: Column, accession: Column) -> Column:
    return F.concat(folder(cik, accession), F.lit("/"), accession, F.lit(".hdr.sgml"))


def document(cik: Column, accession: Column, primary: Column) -> Column:
    """The primary document, or the full submission where none is named."""
    name = F.coalesce(F.nullif(primary, F.lit("")), F.concat(accession, F.lit(".txt")))
    return F.concat(folder(cik, accession), F.lit("/"), name)


def facts(cik: Column) -> Column:
    return F.concat(F.lit(f"{DATA}/api/xbrl/companyfacts/CIK"), _padded(cik), F.lit(".json"))
