"""N-gram Jaccard join with adaptive multi-match prefixes, to components of similar documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.storage import scratch_path
from packetloom.llm.columns import whole
from packetloom.llm.components import components
from packetloom.llm.packing import pack, small
from packetloom.llm.vectors import mix, shingle_sets

#: most shared prefix shingles that a document may ask for, and the cost of a verification in postings
MOST_MATCHES, VERIFY_COST = 4, 20.0
#: documents that are compared directly with each other in one go
BUCKET = 256
DEALS = 3
#: counters of a document's shingles by hash, a byte each
BINS = 64
_SLICE = 1 << 20


def least_overlap(n: int, t: Fraction) -> int:
    """Fewest shingles that a set of ``n`` shares with any set as similar as ``t``."""
    return -(-n * t.numerator // t.denominator)


def counted_share(t: Fraction) -> float:
    """Share of all shingles, by hash, whose document frequency is counted: a little more than prefixes need."""
    return 0.08 + 0.7 * float(1 - t)


def _prefix_tail(n: int, t: Fraction, matches: int) -> int:
    """Length of the prefix in which ``matches`` shared shingles can be asked for."""
    return min(n, n - least_overlap(n, t) + matches)


def _sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    own: list[bytes] = []
    held = 0
    for text in texts:
        own.append(text.encode())
        held += len(own[-1])
        if held >= _SLICE:
            yield from shingle_sets(own, size)
            own, held = [], 0
    if own:
        yield from shingle_sets(own, size)


def _described(docs: DataFrame, size: int, t: Fraction) -> DataFrame:
    """Per document its number of shingles, a 128-bit hash of the set, and the shingles that a prefix may need.

    ``low`` are all shingles below the cut; ``more``, only where these may be too
    few for the prefix, the next ones in order of their hash.
    """

    below = np.uint64(int(counted_share(t) * 2**64))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(rows):
            ns, h1, h2, low, more = [], [], [], [], []
            for s in _sets(batch.column(1).to_pylist(), size):
                cut = int(np.searchsorted(s, below))
                need = max(0, _prefix_tail(len(s), t, MOST_MATCHES) - cut)
                ns.append(len(s))
                h1.append(int(mix(s).sum().view(np.int64)))
                h2.append(int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64)))
                low.append(s[:cut].view(np.int64))
                more.append(s[cut : cut + need].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(c, pa.int64()) for c in (ns, h1, h2)],
                    *[pa.array(c, pa.list_(pa.int64())) for c in (low, more)],
                ],
                ["_id", "n", "h1", "h2", "low", "more"],
            )

    return docs.mapInArrow(run, "_id long, n long, h1 long, h2 long, low array<long>, more array<long>")


def _prefixes(docs: DataFrame, t: Fraction) -> DataFrame:
    """``token, _id, n, matches, df`` of the prefix shingles that other documents may share.

    A document's shingles in global order: those counted, by frequency, then the
    rest. Of every length that asks for 1 to ``MOST_MATCHES`` shared shingles it
    takes the one of the least estimated cost: postings to read, plus the
    verifications of candidates, of which fewer remain the more must match.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(rows):
            out: tuple[list, ...] = ([], [], [], [], [])
            for own, n, n_low, common, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ranked = sorted((c["df"], c["token"]) for c in common or ())
                alone = n_low - len(ranked)  # counted shingles of this document only
                shared = ranked + [(2, x) for x in more]
                best, kept, asked = None, 0, 1
                for matches in range(1, min(MOST_MATCHES, least_overlap(n, t)) + 1):
                    taken = max(0, _prefix_tail(n, t, matches) - alone)
                    postings = sum(df - 1 for df, _ in shared[:taken])
                    cost = postings + VERIFY_COST * postings / matches
                    if best is None or cost < best:
                        best, kept, asked = cost, taken, matches
                for df, token in shared[:kept]:
                    for column, value in zip(out, (token, own, n, asked, df), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["token", "_id", "n", "matches", "df"])

    return docs.select("_id", "n", F.size("low").alias("n_low"), "common", "more").mapInArrow(
        run, "token long, _id long, n long, matches long, df long"
    )


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a bounded number of sets, by products of 0/1 matrices."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]
    row, rank = row[rank >= 0], rank[rank >= 0]
    total = np.zeros((len(sets), len(sets)))
    order = np.argsort(rank, kind="stable")
    row, rank = row[order], rank[order]
    for a in range(0, int(rank[-1]) + 1 if len(rank) else 0, 4096):
        i, j = np.searchsorted(rank, [a, a + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[i:j], rank[i:j] - a] = 1
        total += part @ part.T
    return np.rint(total).astype(np.int64)


def _similar(sets: list[np.ndarray], t: Fraction) -> np.ndarray:
    """Which of the sets are as similar as ``t``."""
    both = overlaps(sets)
    n = np.array([len(s) for s in sets])
    return both * t.denominator >= (n[:, None] + n[None, :] - both) * t.numerator


def _forest(ids: list[int], linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same documents as ``linked``: one fewer than documents in each group."""
    unseen, found = set(range(len(ids))), []
    while unseen:
        stack = [unseen.pop()]
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(linked[i]).tolist():
                if j in unseen:
                    unseen.discard(j)
                    stack.append(j)
                    found.append((ids[i], ids[j]))
    return found


def _bucket_links(members: DataFrame, size: int, t: Fraction) -> DataFrame:
    """Compare the documents of each bucket (at most about ``BUCKET``) with each other."""

    def links(table: pa.Table) -> pa.Table:
        found = []
        for a in range(0, table.num_rows, 2 * BUCKET):  # a bucket dealt by hash is rarely this large
            own = table.slice(a, 2 * BUCKET)
            found += _linked(own, ~np.eye(own.num_rows, dtype=bool), size, t)
        return _as_links(found)

    return members.groupBy("token", "deal", "bucket").applyInArrow(links, "a long, b long")


def size_class(n: str, t: Fraction) -> Column:
    """A number for sizes of sets; those of two sets as similar as ``t`` differ by 1 at most."""
    # a little wider than the ratio of sizes, which rounding cannot undo
    return F.floor(F.log(F.col(n).cast("double")) / (math.log(1 / t) + 1e-6))


def _possible_pairs(counters: np.ndarray, n: np.ndarray, worth: np.ndarray, t: Fraction) -> np.ndarray:
    """Which pairs of sets may be as similar as ``t`` by their sizes and counters, of those ``worth`` a look (all symmetric)."""
    least, most = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    x, y = np.nonzero(np.triu(worth & (least * t.denominator >= most * t.numerator), 1))
    found = np.zeros(worth.shape, bool)
    for a in range(0, len(x), _SLICE // BINS):
        i, j = x[a : a + _SLICE // BINS], y[a : a + _SLICE // BINS]
        found[i, j] = possible(counters[i], counters[j], n[i], n[j], t)
    return found | found.T


def _linked(table: pa.Table, worth: np.ndarray, size: int, t: Fraction) -> list[tuple[int, int]]:
    """Links between the documents of a table, of the pairs ``worth`` a look; sets are made only where counters leave a pair."""
    table = table.combine_chunks()
    counters = _counter_rows(table.column("counters").chunk(0)) if table.num_rows else np.zeros((0, BINS), np.uint8)
    may = _possible_pairs(counters, table.column("n").to_numpy(), worth, t)
    at = np.flatnonzero(may.any(1))
    if not len(at):
        return []
    sets = _unpacked_sets(table.column("_text").take(pa.array(at)).to_pylist(), size)
    return _forest(table.column("_id").to_numpy()[at].tolist(), _similar(sets, t) & may[np.ix_(at, at)])


def _as_links(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _block_links(kept: DataFrame, labels: DataFrame, size: int, t: Fraction) -> DataFrame:
    """Links between different components of documents that have their commonest prefix shingle in common.

    Such a group of more than one bucket falls into cells: a class of sizes and
    the next one, as documents of classes further apart cannot be similar. A cell
    is cut into blocks; each block of documents outside its main component meets
    each block of the cell in one task, which returns no more links than
    documents. So pairs of a hot group are neither listed nor shuffled. Counters
    of shingles rule out most unlike pairs there; sets are made only of documents
    that are left with one, and compared by a product of matrices.
    """
    if "counters" not in kept.columns:
        kept = _sketched(kept, size)
    known = kept.join(labels, "_id", "left").select("_id", "_text", "token", "held", "n", "counters", F.coalesce("component", "_id").alias("component"))
    known = known.where(F.col("held") > BUCKET).withColumn("class", size_class("n", t))
    known = known.withColumn("cell", F.explode(F.array(F.col("class"), F.col("class") - 1)))
    groups = (
        known.groupBy("token", "cell", "component")
        .agg(F.count(F.lit(1)).alias("c"), F.min("class").alias("class"))
        .groupBy("token", "cell")
        .agg(F.sum("c").alias("total"), F.max(F.struct("c", "component")).alias("main"), F.min("class").alias("class"))
        # what has only the larger class meets in the cell of that class
        .where("total > main.c AND class = cell")
        .select("token", "cell", F.col("main.component").alias("main"), *[F.ceil(x / BUCKET).alias(n) for n, x in (("all", F.col("total")), ("outer", F.col("total") - F.col("main.c")))])
    )
    marked = known.drop("held").join(groups, ["token", "cell"])
    inner, outer = F.pmod(F.xxhash64("_id"), "all"), F.pmod(F.xxhash64("_id", F.lit(DEALS)), "outer")
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1), lambda o: F.struct(o.alias("x"), inner.alias("y")))
    asked = F.transform(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), lambda i: F.struct(outer.alias("x"), i.alias("y")))
    places = F.when(F.col("component") == F.col("main"), met).otherwise(F.array_union(met, asked))
    dealt = marked.withColumn("place", F.explode(places)).select(
        "_id", "component", "_text", "n", "counters", (F.col("class") == F.col("cell")).alias("lower"), "token", "cell", "place.x", "place.y"
    )

    def links(table: pa.Table) -> pa.Table:
        own, lower = (table.column(c).to_numpy() for c in ("component", "lower"))
        return _as_links(_linked(table, (own[:, None] != own[None, :]) & (lower[:, None] | lower[None, :]), size, t))

    return dealt.groupBy("token", "cell", "x", "y").applyInArrow(links, "a long, b long")


def _compared(kept: DataFrame, labels: DataFrame, stored) -> DataFrame:
    """``_id, component``: classes within which no pair of documents needs another look.

    A class is what a component, or what a group of one commonest shingle, has
    of documents for which it is the larger of the two.
    """
    known = kept.select("_id", "token").join(labels, "_id", "left").select("_id", "token", F.coalesce("component", "_id").alias("component"))
    both = stored(known.groupBy("component", "token").agg(F.count(F.lit(1)).alias("c"), F.min("_id").alias("least")), "classes")
    linked = both.groupBy("component").agg(F.sum("c").alias("linked"))
    grouped = both.groupBy("token").agg(F.sum("c").alias("grouped"))
    chosen = both.join(linked, "component").join(grouped, "token").withColumn("by_link", F.col("linked") >= F.col("grouped"))
    chosen = chosen.withColumn("of", F.when(F.col("by_link"), F.col("component")).otherwise(F.col("token")))
    least = chosen.groupBy("by_link", "of").agg(F.min("least").alias("label"))
    # written, so that the join may split a class that holds many documents
    named = stored(chosen.join(least, ["by_link", "of"]).select("component", "token", "label"), "classes")
    return known.join(named, ["component", "token"]).select("_id", F.col("label").alias("component"))


def _counters(s: np.ndarray) -> bytes:
    """How many shingles fall into each of ``BINS`` by their hash; 255 stands for all larger numbers."""
    return np.minimum(np.bincount((s % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def _counter_rows(column: pa.Array) -> np.ndarray:
    """A row of ``BINS`` numbers for each value of a column of :func:`_counters`."""
    if not len(column):
        return np.zeros((0, BINS), np.uint8)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + len(column) * BINS].reshape(-1, BINS)


def possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, t: Fraction) -> np.ndarray:
    """Which pairs of sets of ``n`` and ``m`` shingles may be as similar as ``t``, by rows of their counters.

    Two sets share at most the smaller number of each bin; where both numbers are 255 that is not known.
    """
    least = np.minimum(x, y)
    both = least.sum(1, dtype=np.int64)
    return (both * t.denominator >= (n + m - both) * t.numerator) | (least == 255).any(1)


def _candidates(entries: DataFrame, labels: DataFrame, t: Fraction, counters: DataFrame | None = None) -> DataFrame:
    """Pairs of documents in different components that share as many prefix shingles as the more modest of them asks.

    In the postings of a shingle all documents but those of its commonest
    component query the postings, which are cut into blocks; pairs within one
    component need no look; in those of more than one block a document queries only the
    blocks of its class of sizes and the two beside it. Documents of the commonest component query those of
    components with a smaller id. So of any two documents the one of the larger
    component id meets the other at every shingle that they share, and its count
    is whole. A pair that cannot be similar by its ``counters`` is left out where
    it meets, so pairs of a hot group of unlike documents are not listed.
    """
    fields = ("_id", "n", "matches", "component")
    labelled = entries.join(labels, "_id", "left").withColumn("component", F.coalesce("component", "_id"))
    sizes = labelled.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = (
        sizes.groupBy("token")
        # of equally common components the smallest id: large components mostly have small ids
        .agg(
            F.sum("c").alias("total"),
            F.max(F.struct("c", (-F.col("component")).alias("less"))).alias("main"),
            F.min("component").alias("least"),
            F.count(F.lit(1)).alias("kinds"),
        )
        .where("kinds > 1")
        .select("token", "total", F.col("main.c").alias("held"), (-F.col("main.less")).alias("main"), "least")
    )
    marked = labelled.join(mixed, "token")
    # counters at 255 rule out nothing
    marked = marked.withColumn("counters", F.lit(b"\xff" * BINS)) if counters is None else marked.join(counters, "_id")
    outside, before = F.col("component") != F.col("main"), F.col("component") < F.col("main")
    # range 0 of a shingle has all its postings, range 1 those of components before its commonest one
    posted = marked.withColumn("range", F.explode(F.when(before, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    most = F.when(F.col("range") == 0, F.col("total")).otherwise(F.col("total") - F.col("held"))
    # where a range has several blocks, each holds documents of a class of sizes
    hot, own = most > BUCKET, size_class("n", t)
    posted = posted.withColumn("class", F.when(hot, own).otherwise(F.lit(0).cast("long")))
    counts = posted.where(hot).groupBy("token", "range", "class").agg(F.count(F.lit(1)).alias("c"))
    blocks = (
        posted.join(counts, ["token", "range", "class"], "left")
        .withColumn("block", F.pmod(F.xxhash64("_id"), F.ceil(F.coalesce("c", F.lit(1)) / BUCKET)))
        .groupBy("token", "range", "class", "block")
        .agg(F.sort_array(F.collect_list(F.struct(*fields, "counters"))).alias("posts"))
        # an array per field: sorted ids and near equal numbers shrink well in a shuffle, structs do not
        .select("token", "range", "class", *[F.col(f"posts.{f}").alias(f"post{f}") for f in (*fields, "counters")])
    )
    asking = marked.where(outside | (F.col("least") < F.col("main")))
    asking = asking.withColumn("range", F.when(outside, 0).otherwise(1))
    asking = asking.withColumn("class", F.explode(F.when(hot, F.array(own - 1, own, own + 1)).otherwise(F.array(F.lit(0).cast("long")))))
    asked = asking.select("token", "range", "class", *fields, "counters").join(blocks, ["token", "range", "class"])
    # what counts the shared shingles; the rest has been looked at
    told = ("_id", "matches")
    columns = [*told, *[f"post{f}" for f in told]]

    def likely(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(rows):
            posts = batch.column(5)
            sizes = np.diff(posts.offsets.to_numpy())
            query = np.repeat(np.arange(batch.num_rows), sizes)
            n, component = (batch.column(i).to_numpy()[query] for i in (1, 3))
            post = [batch.column(5 + i).flatten() for i in range(5)]
            m = post[1].to_numpy()
            keep = post[3].to_numpy() != component
            keep &= np.minimum(n, m) * t.denominator >= np.maximum(n, m) * t.numerator
            at = np.flatnonzero(keep)
            x, y = _counter_rows(batch.column(4))[query[at]], _counter_rows(post[4])[at]
            at = at[possible(x, y, n[at], m[at], t)]
            left = np.bincount(query[at], minlength=batch.num_rows)
            offsets = pa.array(np.concatenate(([0], np.cumsum(left))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, post[i].take(pa.array(at))) for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], columns).filter(pa.array(left > 0))

    def match(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, held = None, []

        def pairs() -> list[tuple[int, int]]:
            own, matches = query
            post = np.concatenate(held)
            other, first, shared = np.unique(post[:, 0], return_index=True, return_counts=True)
            post = post[first]
            keep = shared >= np.minimum(post[:, 1], matches)
            return [(min(own, o), max(own, o)) for o in other[keep].tolist()]

        for batch in rows:
            found = []
            values = np.stack([batch.column(2 + i).values.to_numpy() for i in range(2)], 1)
            offsets = batch.column(2).offsets.to_numpy()
            for i, row in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True)):
                if query is not None and row[0] != query[0]:
                    found += pairs()
                    held = []
                query = row
                held.append(values[offsets[i] : offsets[i + 1]])
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        if query is not None:
            last = pairs()
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in last], pa.int64()) for k in (0, 1)], ["a", "b"])

    met = asked.select(*fields, "counters", *[f"post{f}" for f in (*fields, "counters")])
    kind = ", ".join([*[f"{f} long" for f in told], *[f"post{f} array<long>" for f in told]])
    by_query = met.mapInArrow(likely, kind).repartition("_id").sortWithinPartitions("_id").select(*columns)
    return by_query.mapInArrow(match, "a long, b long").distinct()


def _sketch(s: np.ndarray) -> bytes:
    """The top 16 bits of every shingle, sorted: a quarter of the set's size."""
    return (s >> np.uint64(48)).astype(np.uint16).tobytes()


def most_overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles two sets can share at most, by their sketches: equal shingles have equal ones."""
    (u, cu), (v, cv) = (np.unique(z, return_counts=True) for z in (x, y))
    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
    return int(np.minimum(cu, cv[at])[v[at] == u].sum())


def _unpacked_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return list(_sets([unpack(t).decode() for t in texts], size))


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """Documents (``_id, _text, held, token``) with their ``sketch``, ``counters`` and ``n``, the number of their shingles."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(rows):
            sets = _unpacked_sets(batch.column(1).to_pylist(), size)
            made = [pa.array([f(s) for s in sets], pa.binary()) for f in (_sketch, _counters)]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made, sizes], [*batch.schema.names, "sketch", "counters", "n"])

    kind = "_id long, _text binary, held long, token long, sketch binary, counters binary, n long"
    return docs.select("_id", "_text", "held", "token").mapInArrow(run, kind)


def _filtered(pairs: DataFrame, kept: DataFrame, column: str, values, overlap, t: Fraction) -> DataFrame:
    """The pairs whose overlap by ``column`` suffices; each pair travels with one of its two values once."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(rows):
            keep = []
            for x, y in zip(*(values(batch.column(i).to_pylist()) for i in (2, 3)), strict=True):
                both = overlap(x, y)
                keep.append(both * t.denominator >= (len(x) + len(y) - both) * t.numerator)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = kept.select(F.col("_id").alias("a"), F.col(column).alias("x"))
    right = kept.select(F.col("_id").alias("b"), F.col(column).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, kept: DataFrame, size: int, t: Fraction) -> DataFrame:
    """The pairs that are as similar as ``t``: most others fail by their sketches, the rest by their sets."""

    def sketches(values: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(v, np.uint16) for v in values]

    def both(x: np.ndarray, y: np.ndarray) -> int:
        return len(np.intersect1d(x, y, assume_unique=True))

    likely = _filtered(pairs, kept, "sketch", sketches, most_overlap, t)
    return _filtered(likely, kept, "_text", lambda v: _unpacked_sets(v, size), both, t)


def similar_groups(docs: DataFrame, threshold: Fraction = Fraction(4, 5), size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: components of documents whose shingle sets are as similar as ``threshold``.

    Words are lower-cased in A-Z; a text of fewer than ``size`` words has its
    whole sequence as one shingle, one without words (or null) has none and
    links with nothing. Ids are integers; rows with the same id and text are one
    document, rows without an id are left out. Every link counts; which of
    several paths joins a group is not reported.

    1. Documents with the same set are one from here on.
    2. Prefix shingles are chosen by document frequency (:func:`_prefixes`);
       shingles of one document only, most of all, go no further.
    3. Documents that share their most frequent prefix shingle are compared in
       buckets of bounded size, which joins most of a large group of near copies;
       those left outside the group's main component then meet all blocks of it
       that hold documents of about their size.
    4. Exactly the pairs that are in different components, were not compared yet
       and share enough of their prefixes are verified. A hot shingle is cut into
       blocks; documents outside its main class query all of them, those inside a part.
       Counters of shingles by hash rule out most unlike pairs before these are listed.
    """
    spark = docs.sparkSession

    def stored(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), whole(text_col).alias("_text")).where("_id is not null")
    described = stored(_described(texts, size, threshold), "shingles")
    classes = described.groupBy("h1", "h2", "n").agg(F.min("_id").alias("rep"))
    members = described.select("_id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"])
    reps = stored(classes.where("n > 0").select(F.col("rep").alias("_id"), F.lit(True).alias("kept")).distinct(), "reps")

    counted = described.select(F.explode("low").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = (
        described.select("_id", F.explode("low").alias("token"))
        .join(counted, "token")
        .groupBy("_id")
        .agg(F.collect_list(F.struct("df", "token")).alias("common"))
    )
    prepared = described.join(reps, "_id", "left_semi").join(common, "_id", "left")
    entries = stored(_prefixes(prepared, threshold), "prefixes")

    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    entries = stored(entries.join(shared, "token").drop("df"), "postings")
    wanted = entries.groupBy("_id").agg(F.max(F.struct("held", "token")).alias("top")).select("_id", "top.token")

    # texts travel compressed, a third of the size of their sets; of several texts of one id the smallest counts
    once = pack(texts, "_text").groupBy("_id").agg(F.min("_text").alias("_text"))
    # documents whose commonest shingle it is, not all that have it
    held = wanted.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    chosen = once.join(stored(wanted.join(held, "token"), "tops"), "_id").select("_id", "_text", "held", "token")
    kept = stored(_sketched(chosen, size), "kept")
    # where several buckets share a shingle, its documents are dealt anew twice, which joins groups of different buckets
    deals = F.when(F.col("held") > BUCKET, F.lit(DEALS - 1)).otherwise(F.lit(0))
    bucketed = kept.withColumn("deal", F.explode(F.sequence(F.lit(0), deals))).select(
        "_id", "_text", "n", "counters", "token", "deal", F.pmod(F.xxhash64("_id", "deal"), F.ceil(F.col("held") / BUCKET)).alias("bucket")
    )
    def stars(labels: DataFrame) -> DataFrame:
        """Links that join what ``labels`` has in a component: later rounds start from these."""
        return labels.select(F.col("_id").alias("a"), F.col("component").alias("b"))

    links = stored(_bucket_links(bucketed, size, threshold), "links")
    labels = stored(components(links).withColumnRenamed("node", "_id"), "labels")
    links = stored(stars(labels).unionByName(_block_links(kept, labels, size, threshold)), "links")
    labels = components(links).withColumnRenamed("node", "_id")
    classes = stored(_compared(kept, labels, stored), "labels")
    found = stored(_verified(_candidates(entries.drop("held"), classes, threshold, kept.select("_id", "counters")), kept, size, threshold), "links")
    final = components(stars(labels).unionByName(found)).select(F.col("node").alias("rep"), "component")
    return members.join(final, "rep", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("_id")).otherwise(F.coalesce("component", "rep")).alias("component_id")
    )
