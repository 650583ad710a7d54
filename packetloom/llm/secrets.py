"""Secret scans: fixed patterns, and strings that zstandard cannot make small even with the code around them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.storage import cut_lineage
from packetloom.llm.columns import whole
from packetloom.llm.packing import small

KINDS = ("assign", "access", "hex", "novel")

# --- fixed values: the base patterns ---
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as [0-9a-f]+ would match
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

# --- candidates of the novelty scan ---
MIN_CHARS, CONTEXT = 16, 96
SENSITIVE = re.compile(rb"(?i)key|secret|token|passw|pwd|auth|credential|bearer|private|signature")
#: a name and the sign that gives it a value, inside a run; ``=`` at the end of a run is padding
NAMED = re.compile(rb"[A-Za-z_][A-Za-z0-9_.-]*=(?=[^=])")
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
_HEXES = np.zeros(256, bool)
_HEXES[list(b"0123456789abcdef")] = True

# --- the dictionary that primes the compressor: the commonest identifiers around candidates, of bounded size ---
DICTIONARY_WORDS, DICTIONARY_BYTES = 8192, 100_000
#: marginal compressed bytes per byte from which a candidate is novel
NOVEL = 0.6

_SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_CANDIDATE = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("before", T.BinaryType()),
        T.StructField("string", T.BinaryType()),
        T.StructField("after", T.BinaryType()),
    ]
)


def _runs(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    first, past = edges[::2], edges[1::2]
    long = past - first >= least
    return list(zip(first[long].tolist(), past[long].tolist(), strict=True))


def base_spans(text: str, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points. ``hexes``: whether the text may hold such a run."""
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    if hexes:
        found += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def candidates(raw: bytes, flags: np.ndarray) -> list[dict]:
    """Strings in a sensitive context, with the code around them; offsets in code points.

    A candidate is a maximal run of ``MIN_CHARS`` or more characters of the
    alphabet of keys, or what follows the last name with ``=`` inside such a run,
    with a digit and a letter, and a sensitive word within ``CONTEXT`` bytes
    before or after it.
    """
    found = []
    codes = np.frombuffer(raw, np.uint8)
    counted = points = 0  # code points in the bytes before ``counted``
    for a, b in _runs(flags, MIN_CHARS):
        for m in NAMED.finditer(raw, a, b):
            a = m.end()
        string, before, after = raw[a:b], raw[max(0, a - CONTEXT) : a], raw[b : b + CONTEXT]
        if len(string) < MIN_CHARS or not (re.search(rb"[0-9]", string) and re.search(rb"[A-Za-z]", string)):
            continue
        if not (SENSITIVE.search(before) or SENSITIVE.search(after)):
            continue
        points += int(np.count_nonzero((codes[counted:a] & 0xC0) != 0x80))
        counted = a
        found.append({"start": points, "end": points + b - a, "before": before, "string": string, "after": after})
    return found


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the base spans and the candidates of each whole text, in one pass without a shuffle."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(rows):
            spans, found = [], []
            for text in batch.column(1).to_pylist():
                raw = text.encode()
                codes = np.frombuffer(raw, np.uint8)
                hexes = bool(_runs(_HEXES[codes], HEX_CHARS))
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base_spans(text, hexes)])
                found.append(candidates(raw, _RUN[codes]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, _arrow(T.ArrayType(_SPAN))), pa.array(found, _arrow(T.ArrayType(_CANDIDATE)))],
                ["_id", "base", "candidates"],
            )

    narrow = df.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    kind = T.StructType([narrow.schema.fields[0], T.StructField("base", T.ArrayType(_SPAN)), T.StructField("candidates", T.ArrayType(_CANDIDATE))])
    return narrow.mapInArrow(run, kind).withColumnRenamed("_id", id_col)


def _arrow(kind: T.DataType) -> pa.DataType:
    simple = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind.fields])
    return simple[kind]


def identifiers(scanned: DataFrame) -> bytes:
    """A raw dictionary of the commonest identifiers around all candidates, the commonest last.

    Counted over every candidate of the corpus; the result has at most
    ``DICTIONARY_BYTES`` bytes, so it can go to every worker.
    """
    around = scanned.select(F.explode("candidates").alias("c")).select(
        F.concat(F.decode("c.before", "ISO-8859-1"), F.lit(" "), F.decode("c.after", "ISO-8859-1")).alias("code")
    )
    words = around.select(F.explode(F.regexp_extract_all("code", F.lit(r"[A-Za-z_][A-Za-z0-9_]{3,39}"), 0)).alias("word"))
    common = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(DICTIONARY_WORDS).collect()
    kept, size = [], 0
    for row in common:
        size += len(row["word"]) + 1
        if size > DICTIONARY_BYTES:
            break
        kept.append(row["word"])
    return " ".join(reversed(kept)).encode()


class Novelty:
    """How many compressed bytes a string adds to the code around it, with a primed compressor."""

    def __init__(self, dictionary: bytes) -> None:
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False).compress

    def ratio(self, before: bytes, string: bytes, after: bytes) -> float:
        """Marginal compressed bytes per byte of ``string``."""
        return (len(self.compress(before + after + string)) - len(self.compress(before + after))) / len(string)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", novel: float = NOVEL) -> DataFrame:
    """One row per row of ``df``: ``id_col`` and ``spans``, an array of (kind, start, end) by start, then kind.

    Kinds are numbered as in ``KINDS``; 0 to 2 are the base patterns, 3 the
    strings of a sensitive context that stay incompressible (a ratio of at least
    ``novel``) and are no base span themselves. Offsets are code points, ends
    exclusive. Null text counts as empty; null ids and repeated rows pass through.

    The text is read once and never shuffled. Spans and candidates, a small part
    of the text, are written once; the dictionary is counted from all of them.
    """
    scanned = cut_lineage(scan(df, id_col, text_col))
    dictionary = df.sparkSession.sparkContext.broadcast(identifiers(scanned))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = Novelty(dictionary.value).ratio
        for batch in small(rows):
            spans = []
            for base, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = {(s["start"], s["end"]) for s in base}
                base += [
                    {"kind": 3, "start": c["start"], "end": c["end"]}
                    for c in found
                    if (c["start"], c["end"]) not in own and ratio(c["before"], c["string"], c["after"]) >= novel
                ]
                spans.append(sorted(base, key=lambda s: (s["start"], s["kind"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _arrow(T.ArrayType(_SPAN)))], ["_id", "spans"])

    kind = T.StructType([T.StructField("_id", scanned.schema[0].dataType), T.StructField("spans", T.ArrayType(_SPAN))])
    return scanned.mapInArrow(run, kind).withColumnRenamed("_id", id_col)
