"""The best rows of many groups: within a task as flat arrays, then over all tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


class Top:
    """The ``k`` best rows of each group so far: highest score first, equal ones by smaller id, missing ids last.

    ``floor`` is the lowest score that may still enter a group.
    """

    def __init__(self, groups: int, k: int, floor: np.ndarray | int) -> None:
        self.k = k
        self.floor = np.full(groups, floor, np.int64)
        self.group = self.score = self.id = np.zeros(0, np.int64)
        self.missing = np.zeros(0, bool)

    def put(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, missing: np.ndarray | None = None) -> None:
        able = score >= self.floor[group]
        if not able.any():
            return
        absent = np.zeros(len(ids), bool) if missing is None else missing
        group, score, ids, absent = (
            np.concatenate([old, new[able]])
            for old, new in ((self.group, group), (self.score, score), (self.id, ids), (self.missing, absent))
        )
        order = np.lexsort((ids, absent, -score, group))
        group = group[order]
        nth = np.arange(len(group)) - np.searchsorted(group, group)
        order, self.group = order[nth < self.k], group[nth < self.k]
        self.score, self.id, self.missing = score[order], ids[order], absent[order]
        last = np.flatnonzero(nth[nth < self.k] == self.k - 1)
        self.floor[self.group[last]] = self.score[last]

    def put_table(self, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """A table of groups x rows, of which every group's ``k`` best and all that tie with them are looked at."""
        bar = self.floor
        if score.shape[1] > self.k:
            place = score.shape[1] - self.k
            bar = np.maximum(bar, np.partition(score, place, axis=1)[:, place])
        group, at = np.nonzero(score >= bar[:, None])
        self.put(group, score[group, at], ids[at], missing[at])


def best_rows(found: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Number the first ``k`` rows of each group from 1; tasks meet in up to ``SALTS`` parts of a group before all do."""
    part = found.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    nth = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    some = part.withColumn(rank, nth).where(F.col(rank) <= k).drop("_part")
    return some.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)
