"""Filter, projection, distinct, exact reduce and epoch join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import EPOCH, SEQ
from packetloom.functions.ordering import running_sum

FILTER_FIELDS = ("src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", "protocol", "dns_ns_type")


def filter_eq(df: DataFrame, conditions: Mapping[str, object]) -> DataFrame:
    """Keep rows where every field equals its literal. Flags are compared as a whole byte, not as a mask."""
    unknown = set(conditions) - set(FILTER_FIELDS)
    if unknown:
        raise ValueError(f"cannot filter on {sorted(unknown)}; fields are {FILTER_FIELDS}")
    return df.where(reduce(Column.__and__, [F.col(f) == F.lit(v) for f, v in conditions.items()], F.lit(True)))


def at_least(df: DataFrame, field: str, threshold: int) -> DataFrame:
    """Keep aggregated or joined rows with ``field >= threshold``."""
    return df.where(F.col(field) >= threshold)


def project(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Keep or compute ``columns``; the epoch stays with the row."""
    return df.select(EPOCH, *columns)


def with_constant(df: DataFrame, name: str, value: int | str) -> DataFrame:
    constant = F.lit(value).cast("long") if isinstance(value, int) else F.lit(value)
    return df.withColumn(name, constant)


def _value(value: Column | str | int) -> Column:
    if isinstance(value, int):
        return F.lit(value).cast("long")
    return F.col(value) if isinstance(value, str) else value


def _rest(df: DataFrame, keys: Sequence[str], skip: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c not in (EPOCH, SEQ, *keys, *skip)]


def distinct_exact(df: DataFrame, keys: Sequence[str], first_row: bool = False) -> DataFrame:
    """One row per key and epoch: the key columns, or the whole first row by ``seq``."""
    if not first_row:
        return df.select(EPOCH, *keys).dropDuplicates()
    rest = _rest(df, keys)
    return (
        df.groupBy(EPOCH, *keys)
        .agg(F.min(SEQ).alias(SEQ), F.min_by(F.struct(*rest), SEQ).alias("_first"))
        .select(EPOCH, SEQ, *keys, "_first.*")
    )


def reduce_exact(df: DataFrame, keys: Sequence[str], value: Column | str | int, out: str = "count") -> DataFrame:
    """Sum of ``value`` per key and epoch (``value=1`` counts). Rows without a value are left out."""
    return (
        df.select(EPOCH, *keys, _value(value).alias("_value"))
        .where(F.col("_value").isNotNull())
        .groupBy(EPOCH, *keys)
        .agg(F.sum("_value").alias(out))
    )


def reduce_running(
    df: DataFrame, keys: Sequence[str], value: Column | str | int, out: str = "count", block_bits: int = 20
) -> DataFrame:
    """Every packet with the running sum of its key, in ``seq`` order."""
    return running_sum(df, [EPOCH, *keys], SEQ, _value(value), out, block_bits)


def reduce_last_row(df: DataFrame, keys: Sequence[str], value: Column | str | int, out: str = "count") -> DataFrame:
    """Sum per key plus the other fields of the key's latest packet."""
    rest = _rest(df, keys, [out])
    return (
        df.withColumn("_value", _value(value))
        .where(F.col("_value").isNotNull())
        .groupBy(EPOCH, *keys)
        .agg(
            F.sum("_value").alias(out),
            F.max(SEQ).alias(SEQ),
            F.max_by(F.struct(*rest), SEQ).alias("_last"),
        )
        .select(EPOCH, SEQ, *keys, out, "_last.*")
    )


def epoch_join(
    left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]
) -> DataFrame:
    """Inner equi-join within an epoch. Where both sides name a column, the left one stays."""
    if len(left_keys) != len(right_keys):
        raise ValueError("left_keys and right_keys must pair up")
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    condition = F.col(EPOCH) == F.col(f"_r_{EPOCH}")
    for lk, rk in zip(left_keys, right_keys):
        condition = condition & (F.col(lk) == F.col(f"_r_{rk}"))
    extra = [F.col(f"_r_{c}").alias(c) for c in right.columns if c not in left.columns]
    return left.join(renamed, condition).select(*left.columns, *extra)


def epoch_join_first(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    right_order: Sequence[str],
) -> DataFrame:
    """As ``epoch_join``, but a left row keeps one match: the first right row by ``right_order``.

    The right side is cut to one row per join key first (with map-side combine),
    so many matches per key are never shuffled or multiplied.
    """
    rest = [c for c in right.columns if c not in (EPOCH, *right_keys)]
    first = (
        right.groupBy(EPOCH, *right_keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*right_order)).alias("_first"))
        .select(EPOCH, *right_keys, "_first.*")
        if rest
        else right.select(EPOCH, *right_keys).dropDuplicates()
    )
    return epoch_join(left, first, left_keys, right_keys)
