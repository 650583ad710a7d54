"""Bloom filters as plans: a filter is the table of its set bits, per epoch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom import EPOCH, SEQ
from packetloom.operators.counters import look_up, slots
from packetloom.operators.relational import distinct_exact


def _bits(df: DataFrame, keys: Sequence[str], size: int, num_hashes: int, seed: int, hash: str) -> DataFrame:
    return slots(df, keys, num_hashes, size, seed, hash).drop("_row")


def bloom_bits(
    df: DataFrame, keys: Sequence[str], size: int = 300000, num_hashes: int = 5, seed: int = 42, hash: str = "md5"
) -> DataFrame:
    """Set bits ``(epoch_id, _bucket)`` after inserting all keys of ``df``."""
    return _bits(df.select(EPOCH, *keys), keys, size, num_hashes, seed, hash).select(EPOCH, "_bucket").dropDuplicates()


def distinct_bloom(
    df: DataFrame,
    keys: Sequence[str],
    size: int = 300000,
    num_hashes: int = 5,
    seed: int = 42,
    hash: str = "md5",
    first_row: bool = False,
) -> DataFrame:
    """First row per key and epoch, minus the keys a Bloom filter takes for already seen.

    Exact in arrival order without a loop: a wrongly dropped key sets no new bit, so
    the time a bit is first set depends on first arrivals only. A key passes if it is
    the one that first set at least one of its bits. So every bit names the key that
    was first to set it, and the keys that are named pass: sums and minima only, with
    map-side combine, and no join. After the first shuffle at most ``size`` rows per
    epoch and task travel on.
    """
    kept = [EPOCH, *keys, SEQ]
    if first_row:
        first = distinct_exact(df, keys, first_row=True)
        kept = first.columns
    else:
        first = df.groupBy(EPOCH, *keys).agg(F.min(SEQ).alias(SEQ))
    touched = _bits(first, keys, size, num_hashes, seed, hash)
    # seq leads, so the smallest struct is that of the first row
    names = F.struct(SEQ, *[c for c in kept if c not in (EPOCH, SEQ)])
    setters = touched.groupBy(EPOCH, "_bucket").agg(F.min(names).alias("_setter")).select(EPOCH, "_setter.*")
    if first_row:
        return setters.dropDuplicates([EPOCH, SEQ]).select(*kept)
    return setters.select(EPOCH, *keys).dropDuplicates()


def bloom_semi_join(
    rows: DataFrame,
    build: DataFrame,
    row_keys: Sequence[str],
    build_keys: Sequence[str],
    size: int = 300000,
    num_hashes: int = 5,
    seed: int = 42,
    hash: str = "md5",
) -> DataFrame:
    """Rows whose key the epoch's filter over ``build`` reports as present (no false negatives).

    Each distinct key is probed once; its rows are then kept by a semi-join.
    """
    bits = bloom_bits(build, build_keys, size, num_hashes, seed, hash)
    probes = _bits(rows.select(EPOCH, *row_keys).dropDuplicates(), row_keys, size, num_hashes, seed, hash)
    present = (
        look_up(probes, bits.withColumn("_set", F.lit(1)), [EPOCH, "_bucket"], row_keys, size, "left")
        .groupBy(EPOCH, *row_keys)
        .agg(F.min(F.coalesce("_set", F.lit(0))).alias("_all_set"))
        .where("_all_set = 1")
        .select(*[F.col(c).alias(f"_p_{c}") for c in (EPOCH, *row_keys)])
    )
    same = F.lit(True)
    for c in (EPOCH, *row_keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    return rows.join(present, same, "left_semi")
