"""Choosing how distinct and reduce are computed: exactly or by a sketch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from packetloom.operators import counters, coupons, membership, relational


def _beaucoup(df, keys, value, out, **params):
    # coupons count packets; the value is not used
    return coupons.reduce_beaucoup(df, keys, out, **params)


REDUCERS = {
    "exact": relational.reduce_exact,
    "cms": counters.reduce_cms,
    "fcm": counters.reduce_fcm,
    "fcm_l1": counters.reduce_fcm_l1,
    "elastic": counters.reduce_elastic,
    "beaucoup": _beaucoup,
}
DISTINCTS = {"exact": relational.distinct_exact, "bloom": membership.distinct_bloom}


def reduce_by(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str | int,
    method: str = "exact",
    out: str = "count",
    **params,
) -> DataFrame:
    """One row per key and epoch with the sum of ``value``, exact or estimated; ``params`` go to the sketch."""
    if method not in REDUCERS:
        raise ValueError(f"unknown reduce method {method!r}: use one of {sorted(REDUCERS)}")
    return REDUCERS[method](df, keys, value, out, **params)


def distinct_by(df: DataFrame, keys: Sequence[str], method: str = "exact", **params) -> DataFrame:
    """Distinct keys per epoch, exact or through a Bloom filter."""
    if method not in DISTINCTS:
        raise ValueError(f"unknown distinct method {method!r}: use one of {sorted(DISTINCTS)}")
    return DISTINCTS[method](df, keys, **params)
