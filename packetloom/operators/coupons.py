"""Coupon collection: estimate load or distinct values from how many coupons a row has collected.

A row of coupons is kept as a bitmap: ``epoch_id, _row, _part, _bits``, with a ``_part``
for each 32,768 coupons. Bitmaps are filled map-side, so a task ships at most 4 KB per
row and part however many packets it has, and tables of bitmaps can be stored and
united over tasks, days or sites.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import EPOCH, SEQ
from packetloom.functions.expressions import bucket, key_text
from packetloom.functions.skew import salted_lookup, salts_for
from packetloom.operators.counters import slots


def coupon_estimate(collected: Column, num_coupons: int) -> Column:
    """Expected draws behind ``collected`` different coupons; 0 for an empty or full row."""
    n = F.lit(float(num_coupons))
    drawn = F.floor(n * F.log(n / (n - collected))).cast("long")
    return F.when((collected > 0) & (collected < num_coupons), drawn).otherwise(F.lit(0).cast("long"))


def _collect(drawn: DataFrame, pairs: Sequence[str]) -> DataFrame:
    collected = drawn.selectExpr(EPOCH, f"inline(array({', '.join(pairs)}))")
    # bits are numbered from 1
    return collected.groupBy(EPOCH, "_row", F.expr("bitmap_bucket_number(_coupon + 1)").alias("_part")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(_coupon + 1))").alias("_bits")
    )


def unite_bitmaps(bitmaps: DataFrame, epoch: Column | str = EPOCH) -> DataFrame:
    """Bitmaps of the same row and ``epoch`` (of a union of tables, or of shorter epochs) in one."""
    return (
        bitmaps.withColumn(EPOCH, F.col(epoch) if isinstance(epoch, str) else epoch)
        .groupBy(EPOCH, "_row", "_part")
        .agg(F.expr("bitmap_or_agg(_bits)").alias("_bits"))
    )


def coupons_held(bitmaps: DataFrame) -> DataFrame:
    """``(epoch_id, _row, _coupons)``: different coupons of each row."""
    return bitmaps.groupBy(EPOCH, "_row").agg(F.sum(F.expr("bitmap_count(_bits)")).alias("_coupons"))


def coupon_bitmaps(
    df: DataFrame,
    keys: Sequence[str],
    num_rows: int = 8,
    num_coupons: int = 32768,
    d: int = 3,
    max_coupons_per_packet: int = 2,
    seed: int = 42,
    hash: str = "md5",
) -> DataFrame:
    """Bitmaps of the coupons that every packet draws in the ``d`` rows picked by its key.

    Draws are a hash of the packet's ``seq``, so they are random over packets but repeatable.
    """
    pairs = [
        f"struct({bucket(seed + i, '_text', num_rows, hash)} AS _row, "
        f"{bucket(seed + i, draw, num_coupons, hash)} AS _coupon)"
        for i in range(d)
        for draw in (f"concat('{j}:', CAST({SEQ} AS STRING))" for j in range(max_coupons_per_packet))
    ]
    return _collect(df.selectExpr(EPOCH, SEQ, f"{key_text(keys)} AS _text"), pairs)


def coupon_table(df: DataFrame, keys: Sequence[str], **params) -> DataFrame:
    """``(epoch_id, _row, _coupons)`` of :func:`coupon_bitmaps`."""
    return coupons_held(coupon_bitmaps(df, keys, **params))


def attribute_bitmaps(
    df: DataFrame,
    keys: Sequence[str],
    attribute: Sequence[str],
    num_rows: int = 8,
    num_coupons: int = 32768,
    d: int = 3,
    seed: int = 42,
    hash: str = "md5",
) -> DataFrame:
    """As ``coupon_bitmaps``, but equal attribute values draw equal coupons: rows count distinct values.

    The coupon has a hash function of its own, so a key that picks one row twice draws no extra coupon.
    """
    pairs = [
        f"struct({bucket(seed + i, '_text', num_rows, hash)} AS _row, "
        f"{bucket(seed + d, '_attribute', num_coupons, hash)} AS _coupon)"
        for i in range(d)
    ]
    return _collect(df.selectExpr(EPOCH, f"{key_text(keys)} AS _text", f"{key_text(attribute)} AS _attribute"), pairs)


def _look_up(
    table: DataFrame, probes: DataFrame, keys: Sequence[str], num_rows: int, d: int, seed: int, hash: str
) -> DataFrame:
    """Distinct probe keys with ``_fullest``, the most coupons in any of their rows (0 if none)."""
    named = probes.select(EPOCH, *keys).dropDuplicates()
    picked = slots(named, keys, d, num_rows, seed, hash).drop("_row").withColumnRenamed("_bucket", "_row")
    return (
        salted_lookup(picked, table, [EPOCH, "_row"], keys, salts_for(num_rows))
        .groupBy(EPOCH, *keys)
        .agg(F.max(F.coalesce("_coupons", F.lit(0))).alias("_fullest"))
    )


def reduce_beaucoup(
    df: DataFrame,
    keys: Sequence[str],
    out: str = "count",
    num_rows: int = 8,
    num_coupons: int = 32768,
    d: int = 3,
    max_coupons_per_packet: int = 2,
    seed: int = 42,
    hash: str = "md5",
) -> DataFrame:
    """Estimate per key from the fullest of its rows. Rows are shared, so this measures row load."""
    bitmaps = coupon_bitmaps(df, keys, num_rows, num_coupons, d, max_coupons_per_packet, seed, hash)
    return estimate_from(bitmaps, df, keys, out, num_rows, num_coupons, d, seed, hash)


def estimate_from(
    bitmaps: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    out: str = "count",
    num_rows: int = 8,
    num_coupons: int = 32768,
    d: int = 3,
    seed: int = 42,
    hash: str = "md5",
) -> DataFrame:
    """Estimate per probe key from stored or united bitmaps."""
    found = _look_up(coupons_held(bitmaps), probes, keys, num_rows, d, seed, hash)
    return found.select(EPOCH, *keys, coupon_estimate(F.col("_fullest"), num_coupons).alias(out))


def coupon_distinct(
    df: DataFrame,
    keys: Sequence[str],
    attribute: Sequence[str],
    out: str = "distinct_values",
    num_rows: int = 8,
    num_coupons: int = 32768,
    d: int = 3,
    seed: int = 42,
    hash: str = "md5",
) -> DataFrame:
    """Estimated number of distinct ``attribute`` values in the fullest row of every key."""
    bitmaps = attribute_bitmaps(df, keys, attribute, num_rows, num_coupons, d, seed, hash)
    return estimate_from(bitmaps, df, keys, out, num_rows, num_coupons, d, seed, hash)


def beaucoup_contains(
    table: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    num_rows: int = 8,
    d: int = 3,
    seed: int = 42,
    hash: str = "md5",
) -> DataFrame:
    """Distinct probe keys of which any row in ``table`` holds a coupon."""
    return _look_up(table, probes, keys, num_rows, d, seed, hash).where("_fullest > 0").drop("_fullest")
