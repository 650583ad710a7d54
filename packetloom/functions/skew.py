"""Joins on few distinct keys, where one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# a lookup should offer at least this many join keys per epoch to spread its rows over
SPREAD = 1024


def salts_for(join_keys: int) -> int:
    """Salts that make up for a lookup with only ``join_keys`` keys per epoch; 1 if it has enough."""
    return max(1, SPREAD // join_keys)


def salted_lookup(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], spread_by: Sequence[str], salts: int, how: str = "left"
) -> DataFrame:
    """Join ``rows`` to ``lookup`` (at most one row per ``on``) with every ``on`` value split ``salts`` ways.

    The salt is a hash of ``spread_by``, so a recomputed task salts alike. Spark is
    still free to broadcast ``lookup`` if its measured size allows.
    """
    if salts == 1:
        return rows.join(lookup, list(on), how)
    # never null, which saves Spark a null test that would make this scan differ from its twin
    salt = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"), F.lit(0))
    salted = rows.withColumn("_salt", salt)
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
