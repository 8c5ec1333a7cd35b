"""Text normalisation and label formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space removed at both ends, tabs, line ends and Unicode spaces included.
OUTER_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim by a set of characters; a regular expression per row would cost far more."""
    return F.btrim(text, F.lit(OUTER_SPACE))


def group_name(text: Column) -> Column:
    """Outer segment names are trimmed and upper-cased."""
    return F.upper(strip(text))


def title_case(text: Column) -> Column:
    """Every run of letters capitalised, also after an apostrophe or a hyphen."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.substring(run, 2, 1 << 30))), "")


def short_label(text: Column, width: int) -> Column:
    """Title case, cut to ``width`` characters: a chart label."""
    return F.substring(title_case(text), 1, width)


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def percent(number: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", number)
