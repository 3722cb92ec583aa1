"""Text columns: comparisons fold only A-Z, blanks are NULL or spaces, queries are normalised on the driver."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNIT = "\x1f"
#: Characters that count as white space in a group key (fixed value).
KEY_SPACE = "\t\n\x0b\x0c\r "
#: Characters that a search query loses besides white space, three invisible ones first (fixed value).
DROPPED = "\u200b\u200c\u200d" "·•・_—–-:：,，.。/\\《》<>[]【】'\""


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x: str | Column) -> Column:
    """A-Z as a-z; other letters stay, so that É and é differ."""
    return F.translate(col(x), UPPER, LOWER)


def contains(x: str | Column, needle: str) -> Column:
    """Whether x holds the needle, A-Z taken as a-z; no character is a wildcard. NULL for NULL."""
    return fold(x).contains(needle.translate(str.maketrans(UPPER, LOWER)))


def any_contains(columns: list[str], needle: str) -> Column:
    out = F.lit(False)
    for x in columns:
        out = out | F.coalesce(contains(x, needle), F.lit(False))
    return out


def filled(x: str | Column) -> Column:
    """Neither NULL nor spaces only."""
    return F.trim(F.coalesce(col(x).cast("string"), F.lit(""))) != ""


def stripped(x: str | Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def normalise(query: str) -> str:
    """NFKC, lower case, without white space and separators."""
    return re.sub(rf"[\s{re.escape(DROPPED)}]+", "", unicodedata.normalize("NFKC", query or "").lower())


@F.pandas_udf(T.StringType())
def normalised(x: pd.Series) -> pd.Series:
    """normalise() for a column; Spark has no NFKC."""
    return x.map(normalise, na_action="ignore")


def split_list(x: str | Column, sep: str = ",") -> Column:
    """Items of a joined list, empty ones dropped."""
    return F.filter(F.split(col(x), re.escape(sep)), lambda v: v != "")


def beijing_day(epoch: str | Column) -> Column:
    """Day (UTC+8, as text) of epoch seconds."""
    return F.date_format(F.timestamp_seconds(col(epoch) + 8 * 3600), "yyyy-MM-dd")


def snake_case(x: str | Column) -> Column:
    """camelCase as camel_case; what is in snake case stays."""
    return F.lower(F.regexp_replace(col(x), "([a-z0-9])([A-Z])", "$1_$2"))
