"""Keys that carry a given share of an epoch, found with few counters and then verified.

Each task keeps at most so many counters per epoch: when there are more, it takes the
largest value that would be left over from all of them and drops those that reach 0.
So a counter is a lower bound of its key's sum in the task, and what was taken in all
is the most that any key can lack. Such summaries are merged by adding them up. A
second pass sums only the keys whose upper bound reaches the share.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom import EPOCH
from packetloom.operators.relational import _value

# executors get this module's functions by value and need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# kinds of rows in a summary
COUNTER, LACK, TOTAL = 0, 1, 2


def _shrink(counters: pa.Table, most: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """At most ``most`` counters per epoch, and what was taken from those of each epoch."""
    epoch, value = counters.column(EPOCH).to_numpy(), counters.column("_value").to_numpy()
    order = np.lexsort((-value, epoch))
    nth = np.arange(len(order)) - np.searchsorted(epoch[order], epoch[order])
    over = order[nth == most]  # the largest that is too much, of each epoch that has one
    epochs, taken = epoch[over], value[over]
    if not len(over):
        return counters, epochs, taken
    at = np.minimum(np.searchsorted(epochs, epoch), len(epochs) - 1)
    left = value - np.where(epochs[at] == epoch, taken[at], 0)
    shrunk = counters.set_column(counters.schema.get_field_index("_value"), "_value", pa.array(left))
    return shrunk.filter(pa.array(left > 0)), epochs, taken


def _count(keys: Sequence[str], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, lack, total = None, {}, {}
        for batch in batches:
            new = pa.Table.from_batches([batch])
            for e, v in zip(*(c.to_pylist() for c in new.group_by(EPOCH).aggregate([("_value", "sum")]).select([EPOCH, "_value_sum"]).columns)):
                total[e] = total.get(e, 0) + v
            both = new if counters is None else pa.concat_tables([counters, new])
            summed = both.group_by([EPOCH, *keys]).aggregate([("_value", "sum")]).rename_columns([EPOCH, *keys, "_value"])
            counters, epochs, taken = _shrink(summed.select(new.column_names), most)
            for e, v in zip(epochs.tolist(), taken.tolist()):
                lack[e] = lack.get(e, 0) + v
        if counters is None:
            return
        kind = pa.array(np.full(len(counters), COUNTER, np.int32))
        yield from counters.append_column("_kind", kind).to_batches()
        for number, values in ((LACK, lack), (TOTAL, total)):
            rows = [{EPOCH: e, "_value": v, "_kind": number} for e, v in values.items()]
            if rows:
                schema = counters.schema.append(pa.field("_kind", pa.int32()))
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def summary(df: DataFrame, keys: Sequence[str], value: Column | str | int, counters: int) -> DataFrame:
    """Merged summaries of all tasks: ``epoch_id, keys, lower, upper, total``.

    ``lower`` and ``upper`` bound the sum of a key, ``total`` is that of its epoch. A key
    that is missing sums to ``upper - lower`` at most, which is not above ``total /
    (counters + 1)``. Values must not be negative.
    """
    if counters < 1:
        raise ValueError("at least one counter is needed")
    narrow = df.select(EPOCH, *keys, _value(value).cast("long").alias("_value")).where("_value > 0")
    kind = T.StructType([*[T.StructField(f.name, f.dataType) for f in narrow.schema], T.StructField("_kind", T.IntegerType())])
    rows = narrow.mapInArrow(_count(keys, counters), kind)
    # one shuffle: what an epoch lacks and its total lie beside its counters under null keys
    merged = rows.groupBy("_kind", EPOCH, *keys).agg(F.sum("_value").alias("_value"))
    about = merged.where(F.col("_kind") > COUNTER).groupBy(EPOCH).agg(
        F.coalesce(F.sum(F.when(F.col("_kind") == LACK, F.col("_value"))), F.lit(0)).alias("_lack"),
        F.sum(F.when(F.col("_kind") == TOTAL, F.col("_value"))).alias("total"),
    )
    bounds = merged.where(F.col("_kind") == COUNTER).join(about, EPOCH)
    return bounds.select(EPOCH, *keys, F.col("_value").alias("lower"), (F.col("_value") + F.col("_lack")).alias("upper"), "total")


def frequent_keys(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str | int,
    one_in: int,
    out: str = "count",
    counters: int | None = None,
) -> DataFrame:
    """Keys with at least a ``one_in``-th of the sum of ``value`` of their epoch, and their exact sums.

    ``one_in`` counters (the default) are enough to find every one of them, whatever
    the number of keys and however the rows are spread; fewer are refused. The
    summary of a task is all that the first pass ships. Candidates, at most as many
    as all tasks have counters, select the rows of the second pass.
    """
    counters = one_in if counters is None else counters
    if counters < one_in:
        raise ValueError(f"{one_in} counters are needed to find every key with one in {one_in}")
    able = summary(df, keys, value, counters).where(F.col("upper") * one_in >= F.col("total"))
    candidates = able.select(F.col("total").alias("_total"), *[F.col(c).alias(f"_c_{c}") for c in (EPOCH, *keys)])
    same = F.lit(True)
    for c in (EPOCH, *keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    rows = df.select(EPOCH, *keys, _value(value).cast("long").alias("_value"))
    sums = rows.join(candidates, same).groupBy(EPOCH, *keys).agg(F.sum("_value").alias(out), F.first("_total").alias("_total"))
    return sums.where(F.col(out) * one_in >= F.col("_total")).drop("_total")
