"""Line deduplication against levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.storage import cut_lineage, scratch_path
from packetloom.llm.columns import ascii_lower, packed, strip_spaces, unpacked, whole

MIN_KEY_CHARS = 10
_HASH = ["_h1", "_h2"]


class LineRuns:
    """Every line hash seen so far with the first document that had it, as levels of sorted runs.

    A run is a table bucketed and sorted by the 128-bit hash, in the shared
    folder. All runs have the same buckets, so a batch is shuffled once and then
    merged with each run bucket by bucket, without moving the runs. Keys of
    different runs differ. When a level holds ``fan_in`` runs they are merged
    into one of the next level, so n batches leave about fan_in * log(n) runs
    and a key is rewritten once per level. Use it as a context manager: the
    table names go at the end, the files are scratch data of the shared folder.
    """

    def __init__(self, spark: SparkSession, fan_in: int = 3, buckets: int | None = None) -> None:
        if fan_in < 2:
            raise ValueError("fan_in must be at least 2")
        self.spark = spark
        self.fan_in = fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.tables: list[str] = []

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            df.write.format("parquet")
            .bucketBy(self.buckets, *_HASH)
            .sortBy(*_HASH)
            .option("path", scratch_path(self.spark, name))
            .saveAsTable(name)
        )
        self.tables.append(name)
        return name

    def _new_keys(self, name: str) -> DataFrame:
        return self.spark.table(name).where("_new").select(*_HASH, "_keep")

    def add(self, keys: DataFrame) -> DataFrame:
        """Merge a batch into the runs and return its keys with the verdict on each.

        ``keys`` has one row per hash: ``_h1 _h2 _first _last``, the smallest and
        largest document of the batch with it. No document of the batch may be
        smaller than one of an earlier batch. ``_keep`` is the document that keeps
        the line, ``_repeated`` whether any other has it.
        """
        known = keys
        seen = F.lit(None).cast("long")
        for i, run in enumerate(name for level in self.levels for name in level):
            # all but the matches stay: the anti-join is the test for null below
            known = known.join(self._new_keys(run).withColumnRenamed("_keep", f"_run{i}"), _HASH, "left")
            seen = F.coalesce(seen, F.col(f"_run{i}"))
        judged = known.select(
            *_HASH,
            F.coalesce(seen, F.col("_first")).alias("_keep"),
            seen.isNull().alias("_new"),
            (seen.isNotNull() | (F.col("_first") < F.col("_last"))).alias("_repeated"),
        )
        batch = self._write(judged.repartition(self.buckets, *_HASH) if self.levels == [] else judged)
        self._add_run(batch, 0)
        return self.spark.table(batch)

    def _add_run(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan_in:
            merged = None
            for run in self.levels[level]:
                merged = self._new_keys(run) if merged is None else merged.unionByName(self._new_keys(run))
            self.levels[level] = []
            compacted = merged.withColumns({"_new": F.lit(True), "_repeated": F.lit(False)})
            self._add_run(self._write(compacted.repartition(self.buckets, *_HASH)), level + 1)

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # external: the files stay for plans that still read them


def line_key(line: Column) -> Column:
    """What makes two lines equal: stripped of white space at both ends, A-Z in lower case."""
    return ascii_lower(strip_spaces(line))


def _ranges(docs: DataFrame, order: Column, batches: int) -> list[int]:
    """At most ``batches - 1`` cut points that split the documents into near equal ranges of ids."""
    if batches < 2:
        return []
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(order, shares, 10_000).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_KEY_CHARS,
    batches: int = 4,
    fan_in: int = 3,
    n_lines: str | None = None,
    n_dropped: str | None = None,
) -> DataFrame:
    """Drop repeated lines: of a key in several documents, only the smallest document keeps its lines.

    Documents come in ``batches`` ranges of rising ids, as they would arrive;
    each batch meets the runs of all earlier ones. Lines whose key is shorter
    than ``min_chars`` code points stay. All columns stay, the text is replaced;
    ``n_lines`` and ``n_dropped`` name columns for the counts (an input column of
    that name gives way).

    Null text is one empty line. Rows without an id count as one document after
    all others; rows with the same id count as the same document, so a line that
    only they share stays. An empty table gives an empty table.

    Native functions only. Per line 16 bytes of hash travel, not its text. A key
    that many documents share is combined map-side before its hash meets the
    runs; the join that finds its lines is a plain equi-join, which adaptive
    execution splits where one key is hot.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    cuts = _ranges(docs, order, batches)
    batch = sum((F.when(order > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    text = whole(text_col)
    base = packed(docs, _doc=order, _text_hash=F.xxhash64(text), _text=text, _lines=F.split(text, "\n", -1), _batch=batch)

    lines = (
        base.select("_doc", "_text_hash", "_batch", F.posexplode("_lines").alias("_pos", "_line"))
        .select("_doc", "_text_hash", "_batch", "_pos", line_key(F.col("_line")).alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select(
            "_doc", "_text_hash", "_batch", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2")
        )
    )
    path = scratch_path(spark, "lines")
    lines.write.partitionBy("_batch").parquet(path)
    lines = spark.read.schema("_doc long, _text_hash long, _pos int, _h1 long, _h2 long, _batch int").parquet(path)

    dropped = None
    with LineRuns(spark, fan_in) as runs:
        for b in range(len(cuts) + 1):
            own = lines.where(F.col("_batch") == b)
            keys = own.groupBy(*_HASH).agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last"))
            repeated = runs.add(keys).where("_repeated").select(*_HASH, "_keep")
            hits = own.join(repeated, _HASH).where("_doc <> _keep").select("_doc", "_text_hash", "_pos")
            dropped = hits if dropped is None else dropped.unionByName(hits)
        # read from the runs before their names go
        dropped = cut_lineage(dropped.groupBy("_doc", "_text_hash").agg(F.collect_set("_pos").alias("_dropped")))

    joined = base.join(dropped, ["_doc", "_text_hash"], "left")
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    # array_except looks positions up in a hash set: linear, unlike a search per line
    kept = F.transform(F.array_except(every, F.col("_dropped")), lambda i: F.get("_lines", i))
    added = {text_col: F.when(F.col("_dropped").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))}
    if n_lines:
        added[n_lines] = F.size("_lines").cast("long")
    if n_dropped:
        added[n_dropped] = F.coalesce(F.size("_dropped"), F.lit(0)).cast("long")
    return unpacked(joined, docs.columns, added)
