"""Column expressions that several corpus operators share."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# the white space of the corpus operators: space, and tab to carriage return
SPACES = " \t\n\x0b\x0c\r"


def whole(text: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    ``lower`` does just that for pure ASCII and is much cheaper than ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def strip_spaces(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """The whole row in one struct ``_row`` beside the columns ``more``.

    Operators work on their own columns this way, whatever names the input has.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[v.alias(k) for k, v in more.items()])


def unpacked(df: DataFrame, columns: Sequence[str], added: dict[str, Column]) -> DataFrame:
    """The input columns again with ``added``; an input column of an added name (in any case) gives way in place."""
    new = {k.lower(): v.alias(k) for k, v in added.items()}
    kept = [new.pop(c.lower(), None) for c in columns]
    return df.select(
        *[F.col("_row").getField(c).alias(c) if k is None else k for c, k in zip(columns, kept, strict=True)], *new.values()
    )
