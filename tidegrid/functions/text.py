"""Parsing and repairing stamps and names that arrive as text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stamp formats of the landed files.
MINUTE_FORMAT = "yyyy-MM-dd HH:mm"
SLASH_FORMAT = "M/d/yyyy H:mm"


def parse_minute(text: str | Column) -> Column:
    """``yyyy-MM-dd HH:mm``; anything after the minute is ignored."""
    text = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(F.substring(text, 1, 16), F.lit(MINUTE_FORMAT))


def parse_any(text: str | Column, *formats: str) -> Column:
    """First format that fits; null if none does."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def repair_century(text: str | Column) -> Column:
    """Overwrite the first two characters of a year by ``20``."""
    text = F.col(text) if isinstance(text, str) else text
    return F.overlay(text, F.lit("20"), 1, 2)


def clean_names(df: DataFrame) -> DataFrame:
    """Column names without blanks and with ``_`` for ``-``."""
    return df.toDF(*[re.sub("-", "_", re.sub(" ", "", c)) for c in df.columns])
