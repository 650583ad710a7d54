"""Packet capture files (classic captures and block captures, any byte order and clock) as frames.

Spark lists the files and cuts them into byte ranges; a task decodes one range at a
time with NumPy. Records have no marker to synchronise on, so a range in the middle
of a file *guesses* its first record. The guesses are then checked: walking a range
must end exactly where the next one starts. A file in which one fails is looked at
once more, without guessing: every range works out where the records lead from each
offset at which its first one could begin. These maps are composed by doubling, so
the true starts are known after a number of small joins that grows with the
logarithm of the ranges, and the result never depends on how well guessing works.

Paths may be local or on any storage that Arrow opens by URI (HDFS, S3, GCS).
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import chains
from packetloom.functions.expressions import floor_div
from packetloom.functions.ordering import total_before
from packetloom.functions.storage import cut_lineage, measured
from packetloom.sources import formats
from packetloom.sources.tables import FRAME_COLUMNS, tcp_only

# executors get this module's functions by value and need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values of the network layers
ETHERTYPE_IPV4 = 0x0800
TCP = 6

BATCH_RECORDS = 100_000

RANGE = "path string, length long, base long, lo long, hi long, start long, stop long, ended boolean"
DECODED = pa.schema(
    [
        ("seq", pa.int64()),
        ("ts_us", pa.int64()),
        ("src", pa.int64()),
        ("dst", pa.int64()),
        ("src_port", pa.int32()),
        ("dst_port", pa.int32()),
        ("tcp_flags", pa.int32()),
        ("total_len", pa.int64()),
        ("protocol", pa.int32()),
    ]
)


def _open(path: str):
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if path.startswith("/"):
        return pyarrow.fs.LocalFileSystem().open_input_file(path)
    fs, inner = pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.open_input_file(inner)


def _layout(file, path: str) -> formats.Classic | formats.Blocks:
    return formats.format_of(file.read_at(formats.HEAD_BYTES, 0), path)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Guess where a range's first record starts, and say where the next range's must."""
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            lo, hi = row["lo"], row["hi"]
            with _open(row["path"]) as file:
                layout = _layout(file, row["path"])
                data = file.read_at(min(hi + layout.longest, row["length"]) - lo, lo)
            if lo == 0:
                row["start"] = min(layout.first, hi)
            else:
                align = -lo % layout.step
                guess = formats.guess_start(layout, data, align)
                row["start"] = hi if guess is None else min(lo + guess, hi)
            _, after, row["ended"] = formats.hop(layout, data, row["start"] - lo, hi - lo)
            row["stop"] = lo + after
        yield pa.RecordBatch.from_pylist(rows, batch.schema)


MAP = pa.schema(
    [
        ("path", pa.string()),
        ("lo", pa.int64()),
        ("first", pa.int64()),
        ("step", pa.int64()),
        ("table", pa.binary()),
        ("ends", pa.list_(pa.int64())),
        ("over", pa.list_(pa.bool_())),
    ]
)
STEPS = pa.schema([("path", pa.string()), ("lo", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("ended", pa.bool_())])


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the records of each range lead from every offset at which its first one may begin.

    ``table`` has, for the offsets ``first``, ``first + step``, ..., a place in
    ``ends`` and ``over`` (-1: no record can begin there). Nearly all places are
    -1 or a few others, so it is stored compressed.
    """
    for batch in batches:
        for row in batch.to_pylist():
            lo, hi = row["lo"], row["hi"]
            with _open(row["path"]) as file:
                layout = _layout(file, row["path"])
                data = file.read_at(min(hi + layout.longest, row["length"]) - lo, lo)
            align = -lo % layout.step
            offsets, place, ends, over = formats.exits(layout, data, align, hi - lo)
            if lo == 0:
                place[offsets != layout.first] = -1
            over |= ends + lo >= row["length"]
            used, place[place >= 0] = np.unique(place[place >= 0], return_inverse=True)
            table = zlib.compress(place.astype(np.int32).tobytes(), 1)
            columns = row["path"], lo, lo + align, layout.step, table, (ends[used] + lo).tolist(), over[used].tolist()
            yield pa.RecordBatch.from_pylist([dict(zip(MAP.names, columns, strict=True))], MAP)


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the records of a range lead from the ``starts`` that are asked for."""
    for batch in batches:
        for row in batch.to_pylist():
            table = np.frombuffer(zlib.decompress(row["table"]), np.int32)
            found = []
            for start in row["starts"]:
                place = int(table[(start - row["first"]) // row["step"]])
                stop, ended = (start, True) if place < 0 else (row["ends"][place], row["over"][place])
                found.append(dict(zip(STEPS.names, (row["path"], row["lo"], start, stop, ended), strict=True)))
            yield pa.RecordBatch.from_pylist(found, STEPS)


def _repaired(ranges: DataFrame, split_bytes: int) -> DataFrame:
    """The ranges of whole files with the true start and stop of each, found without a guess."""
    maps = cut_lineage(_spread(ranges, ranges.count()).mapInArrow(_map, "path string, lo long, first long, step long, table binary, ends array<long>, over array<boolean>"))
    roots = ranges.where("lo = 0").select("path", "start")
    led = maps.select("path", F.explode(F.arrays_zip("ends", "over")).alias("e")).where("NOT e.over").select("path", F.col("e.ends").alias("start"))
    asked = led.unionByName(roots).distinct().withColumn("lo", floor_div("start", split_bytes) * split_bytes)
    starts = measured(asked.groupBy("path", "lo").agg(F.collect_list("start").alias("starts")))
    gathered = starts.join(maps, ["path", "lo"])
    steps = cut_lineage(gathered.mapInArrow(_look_up, "path string, lo long, start long, stop long, ended boolean"))
    pointers = steps.select("path", "start", F.expr("CASE WHEN NOT ended THEN stop END").alias("next"))
    true = chains.reached(pointers, roots, ["path"]).join(steps, ["path", "start"])
    found = ranges.drop("start", "stop", "ended").join(true, ["path", "lo"], "left")
    # no record starts in the others
    return found.select(
        "path", "length", "base", "lo", "hi", *[F.coalesce(c, d).alias(c) for c, d in (("start", "hi"), ("stop", "hi"), ("ended", F.lit(False)))]
    )


def _decode_records(data: bytes, records: formats.Records, position: int) -> pa.RecordBatch:
    """Ethernet / IPv4 / TCP fields of the records; null where a layer is missing or cut off."""
    raw = np.frombuffer(data, np.uint8)

    def byte(at: np.ndarray) -> np.ndarray:
        return formats.words(raw, at, ">", 1)

    def big16(at: np.ndarray) -> np.ndarray:
        return formats.words(raw, at, ">", 2)

    def big32(at: np.ndarray) -> np.ndarray:
        return formats.words(raw, at, ">", 4)

    captured = records.captured
    ip = records.frame + 14
    is_ip = (captured >= 34) & (big16(ip - 2) == ETHERTYPE_IPV4)
    total = big16(ip + 2)
    header = np.maximum((byte(ip) & 15) * 4, 20)
    protocol = byte(ip + 9)
    tcp = ip + header
    tcp_bytes = np.minimum(captured - 14 - header, total - header)
    is_tcp = is_ip & (protocol == TCP) & (tcp_bytes >= 20)
    known = is_ip & (is_tcp | (protocol != TCP))  # a cut-off TCP header is no packet

    def column(values: np.ndarray, present: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.array(values, mask=~present).cast(kind)

    every = np.ones(len(captured), bool)
    columns = [
        (position + records.start, every),
        (records.ts_us, every),
        (big32(ip + 12), is_ip),
        (big32(ip + 16), is_ip),
        (big16(tcp), is_tcp),
        (big16(tcp + 2), is_tcp),
        (byte(tcp + 13), is_tcp),
        (total, is_ip),
        (protocol, known),
    ]
    return pa.RecordBatch.from_arrays([column(v, m, f.type) for (v, m), f in zip(columns, DECODED)], schema=DECODED)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            if row["start"] >= min(row["hi"], row["stop"]):
                continue
            with _open(row["path"]) as file:
                layout = _layout(file, row["path"])
                data = file.read_at(row["stop"] - row["start"], row["start"])
            starts, _, _ = formats.hop(layout, data, 0, min(row["hi"], row["stop"]) - row["start"])
            for i in range(0, len(starts), BATCH_RECORDS):
                records = layout.read(data, np.array(starts[i : i + BATCH_RECORDS], np.int64), i == 0 and row["start"] == layout.first)
                if len(records.start):
                    yield _decode_records(data, records, row["base"] + row["start"])


def _spread(ranges: DataFrame, count: int) -> DataFrame:
    """One range per task, in order of position: the rows are tiny, but not the bytes they stand for."""
    return ranges.repartitionByRange(max(1, count), "base", "lo").sortWithinPartitions("base", "lo")


def capture_ranges(spark: SparkSession, path: str, split_bytes: int, glob: str | None = None) -> DataFrame:
    """Checked byte ranges of all capture files: every record starts in exactly one of them."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        listing = listing.option("pathGlobFilter", glob)
    # file names and lengths only: the content column is never read
    files = total_before(listing.load(path).select("path", "length"), "path", "length", "base")
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes)))
    ranges = (
        files.withColumn("lo", cuts)
        .withColumn("hi", F.least(F.col("lo") + split_bytes, F.col("length")))
        .withColumns({"start": F.lit(None).cast("long"), "stop": F.lit(None).cast("long"), "ended": F.lit(False)})
        .select(*[c.split()[0] for c in RANGE.split(", ")])
    )
    ranges = cut_lineage(ranges)
    walked = cut_lineage(_spread(ranges, ranges.count()).mapInArrow(_walk, RANGE))
    # a range must start where the one before it stops, and the capture must not end before the last one
    before = walked.select("path", F.col("hi").alias("lo"), F.col("stop").alias("_stop"), F.col("ended").alias("_ended"))
    checked = walked.join(before, ["path", "lo"])
    wrong = checked.where((F.col("_stop") != F.col("start")) | F.col("_ended")).select("path").distinct()
    wrong = cut_lineage(wrong)
    if wrong.isEmpty():
        return walked
    repaired = _repaired(walked.join(wrong, "path", "left_semi"), split_bytes)
    return cut_lineage(walked.join(wrong, "path", "left_anti").unionByName(repaired))


def frames_from_pcap(spark: SparkSession, path: str, split_bytes: int = 128 << 20, glob: str | None = None) -> DataFrame:
    """All frames of the capture files below ``path``, in the ``frames`` layout.

    ``seq`` is the byte position in the files laid end to end by path: unique and
    increasing in capture order without counting records. The frames lie in this
    order, from partition to partition.
    """
    ranges = capture_ranges(spark, path, split_bytes, glob)
    decoded = _spread(ranges, ranges.count()).mapInArrow(
        _decode,
        "seq long, ts_us long, src long, dst long, src_port int, dst_port int, tcp_flags int, total_len long, "
        "protocol int",
    )

    def dotted(address: str) -> str:
        octets = [f"CAST(shiftright({address}, {bits}) & 255 AS STRING)" for bits in (24, 16, 8, 0)]
        return f"CASE WHEN {address} IS NOT NULL THEN concat_ws('.', {', '.join(octets)}) END"

    return decoded.selectExpr(
        "seq",
        "timestamp_micros(ts_us) AS ts",
        "unix_seconds(timestamp_micros(ts_us)) AS ts_sec",
        f"{dotted('src')} AS src_ip",
        f"{dotted('dst')} AS dst_ip",
        "src_port",
        "dst_port",
        "tcp_flags",
        "total_len",
        "protocol",
        "CAST(NULL AS INT) AS dns_ns_type",
    ).select(*FRAME_COLUMNS)


def packets_from_pcap(spark: SparkSession, path: str, **options) -> DataFrame:
    """The TCP packets of the capture files below ``path``."""
    return tcp_only(frames_from_pcap(spark, path, **options))


_IP = ">u4"
# a record of a classic capture: its header, then Ethernet, IPv4 and TCP headers without payload
RECORD = np.dtype(
    [
        ("sec", ">u4"), ("micros", ">u4"), ("captured", ">u4"), ("full", ">u4"),
        ("hardware", "V12"), ("kind", ">u2"),
        ("version", "u1"), ("service", "u1"), ("total", ">u2"), ("id", ">u4"), ("hops", "u1"), ("protocol", "u1"),
        ("sum", ">u2"), ("src", _IP), ("dst", _IP),
        ("src_port", ">u2"), ("dst_port", ">u2"), ("number", ">u8"), ("size", "u1"), ("flags", "u1"), ("window", "V6"),
    ]
)


def write_pcap(frames: DataFrame, path: str) -> None:
    """Write frames as classic captures below ``path``: their headers only, in order of ``seq`` from file to file.

    One file per task, written by Arrow; a task that runs again writes the same
    file again. Frames without a protocol become frames of another kind than IPv4;
    other missing fields become 0.
    """
    fields = frames.orderBy("seq").select(
        F.unix_micros("ts").alias("ts_us"), *["src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", "total_len", "protocol"]
    )
    numbered = fields.withColumn("_slice", F.spark_partition_id())
    numbered.mapInArrow(_encode(path), "records long").agg(F.sum("records")).collect()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, written = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = _create(f"{path}/part-{batch.column(8)[0].as_py():08d}.pcap")
                out.write(np.array([0xA1B2C3D4, 0x00020004, 0, 0, 65535, formats.ETHERNET], ">u4").tobytes())
            out.write(_records(batch).tobytes())
            written += batch.num_rows
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"records": [written]})

    return run


def _create(path: str):
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    fs, inner = (pyarrow.fs.LocalFileSystem(), path) if path.startswith("/") else pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(inner)


def _records(batch: pa.RecordBatch) -> np.ndarray:
    def numbers(name: str) -> np.ndarray:
        return batch.column(name).fill_null(0).to_numpy().astype(np.int64)

    def address(name: str) -> np.ndarray:
        octets = [[int(x) for x in a.split(".")] if a else [0, 0, 0, 0] for a in batch.column(name).to_pylist()]
        return np.array(octets, np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])

    out = np.zeros(batch.num_rows, RECORD)
    out["sec"], out["micros"] = np.divmod(numbers("ts_us"), 1_000_000)
    out["captured"] = RECORD.itemsize - formats.RECORD_HEADER
    out["full"] = np.maximum(out["captured"], 14 + numbers("total_len"))
    out["kind"] = np.where(batch.column("protocol").is_valid().to_numpy(zero_copy_only=False), ETHERTYPE_IPV4, 0)
    out["version"], out["size"], out["hops"] = 0x45, 0x50, 64
    for name, source in (("total", "total_len"), ("protocol",) * 2, ("src_port",) * 2, ("dst_port",) * 2, ("flags", "tcp_flags")):
        out[name] = numbers(source)
    out["src"], out["dst"] = address("src_ip"), address("dst_ip")
    return out
