"""Scalar expressions: integer arithmetic, flow labels and bucket hashes. All stay JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "<missing>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def add(a: Column | str, b: Column | str) -> Column:
    return _col(a) + _col(b)


def subtract_floor0(a: Column | str, b: Column | str) -> Column:
    """Difference, floored at 0 (null if either side is null)."""
    diff = _col(a) - _col(b)
    return F.when(diff < 0, F.lit(0)).otherwise(diff)


def multiply(a: Column | str, b: Column | str) -> Column:
    return _col(a) * _col(b)


def divide_or_zero(a: Column | str, b: Column | str) -> Column:
    """Integer quotient; 0 when the divisor is 0."""
    a, b = _col(a), _col(b)
    # nullif keeps the division legal on every row, also under ANSI mode
    quotient = F.call_function("div", a, F.nullif(b, F.lit(0)))
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(quotient)


def floor_div(a: Column | str, n: int) -> Column:
    """Integer division that rounds down, also for negative ``a``."""
    a = _col(a)
    return F.call_function("div", a - F.pmod(a, F.lit(n)), F.lit(n))


def flow_key(keys: Sequence[str]) -> Column:
    """Label ``"k: v, k2: v2"``. For reports only: grouping uses the real columns."""
    parts = [F.concat(F.lit(f"{k}: "), F.coalesce(F.col(k).cast("string"), F.lit(MISSING))) for k in keys]
    return F.concat_ws(", ", *parts)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def key_text(keys: Sequence[str]) -> str:
    """SQL for the text that is hashed for a key."""
    parts = [f"coalesce(CAST({quoted(k)} AS STRING), '{MISSING}')" for k in keys]
    return f"concat_ws(',', {', '.join(parts)})"


def bucket(index: int, text: str, width: int, hash: str = "md5") -> str:
    """SQL for the bucket ``0 .. width - 1`` of ``text`` under hash function number ``index``.

    ``md5`` uses the leading 32 bits of the digest, so any SQL engine can compute
    the same bucket; ``xxhash64`` is the fast choice.
    """
    if hash == "md5":
        return f"CAST(conv(substring(md5(concat('{index}:', {text})), 1, 8), 16, 10) AS BIGINT) % {width}L"
    if hash == "xxhash64":
        return f"pmod(xxhash64({index}, {text}), {width}L)"
    raise ValueError(f"unknown hash {hash!r}: use 'md5' or 'xxhash64'")
