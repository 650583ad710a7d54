"""Byte-pair encoding by forced boundaries: cut where no token can reach across, encode the pieces, concatenate."""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.columns import whole
from packetloom.llm.packing import small

# entries of each worker's memo of chunks and of words; full memos start anew
_MEMO = 450_000
# in fragments of more symbols, merges go through a heap instead of a rescan
_SHORT = 64
# code points of a chunk that the memo still holds
_MEMO_CHARS = 64


class ForcedBoundaryBpe:
    """Encodes texts with a word-end BPE vocabulary file of the tokenizers library.

    Certain cuts come in three widths, each from the vocabulary or its rules:
    special tokens and ASCII white space cut a text into chunks, since no token
    holds white space; the file's own pattern cuts a chunk into words, since the
    word-end mark closes a token; and inside a word every pair of neighbouring
    byte symbols that no vocabulary token contains is cut, since no merge can
    ever join across it. Fragments between cuts are encoded on their own.
    """

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if model["type"] != "BPE" or any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("this vocabulary has rules that the encoder does not know")
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # a pair of ids as one integer, which is a cheaper key than a tuple
        self.rank = {self.ids[a] << 32 | self.ids[b]: i for i, (a, b) in enumerate(merges)}
        self.merged = [self.ids[a + b] for a, b in merges]
        self.normalize = Tokenizer.from_str(file).normalizer.normalize_str
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        # a special token stays whole in the raw text, before anything is normalized
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.pairs = self._pairs()
        symbols = _byte_symbols()
        self.inner = [self.ids[c] for c in symbols]
        self.last = [self.ids[c + self.end] for c in symbols]
        self.word_memo: dict[str, bytes] = {}
        self.chunk_memo: dict[bytes, bytes] = {}

    def _pairs(self) -> set[int]:
        """Every pair of byte symbols that stands side by side in some token; the last one has the word-end mark."""
        found: set[int] = set()
        for token in self.ids:
            ended = token.endswith(self.end) and len(token) > len(self.end)
            symbols = list(token[: -len(self.end)] if ended else token)
            if ended:
                symbols[-1] += self.end
            found.update(self.ids[a] << 32 | self.ids[b] for a, b in zip(symbols, symbols[1:], strict=False))
        return found

    def fragments(self, symbols: list[int]) -> list[list[int]]:
        """A word's symbols, cut at every pair that no token contains."""
        cuts = [i for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False), 1) if a << 32 | b not in self.pairs]
        if not cuts:
            return [symbols]
        return [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True)]

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges of the vocabulary, lowest rank first, leftmost first among equals."""
        if len(ids) > _SHORT:
            return self._merge_long(ids)
        rank, none = self.rank.get, len(self.merged)
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i : i + 2] = [self.merged[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps: a heap of possible merges over a linked list of symbols."""
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        heap = [(r, i, p) for i, p in enumerate(a << 32 | b for a, b in zip(ids, ids[1:], strict=False)) if (r := self.rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or ids[i] << 32 | ids[j] != pair:
                continue
            ids[i], ids[j] = self.merged[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.rank.get(p := ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a, p))
        return [x for x in ids if x >= 0]

    def encode_word(self, word: str) -> bytes:
        found = self.word_memo.get(word)
        if found is None:
            raw = word.encode()
            symbols = [self.inner[b] for b in raw[:-1]]
            symbols.append(self.last[raw[-1]])
            found = _pack([t for f in self.fragments(symbols) for t in self.merge(f)])
            if len(word) <= _MEMO_CHARS:
                if len(self.word_memo) >= _MEMO:
                    self.word_memo.clear()
                self.word_memo[word] = found
        return found

    def encode_chunk(self, chunk: bytes) -> bytes:
        """Ids of a stretch without ASCII white space, as little-endian unsigned 32-bit integers."""
        found = self.chunk_memo.get(chunk)
        if found is not None:
            return found
        ids: list[bytes] = []
        raw = chunk.decode()
        for part in self.split_special(raw) if "<|" in raw else (raw,):
            if part in self.special:
                ids.append(_pack([self.special[part]]))
            else:
                ids += map(self.encode_word, self.words(part.lower() if part.isascii() else self.normalize(part)))
        found = b"".join(ids)
        if len(chunk) <= _MEMO_CHARS:
            if len(self.chunk_memo) >= _MEMO:
                self.chunk_memo.clear()
            self.chunk_memo[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        chunks = text.encode().split()
        known = list(map(self.chunk_memo.get, chunks))
        if None in known:
            known = [self.encode_chunk(c) if k is None else k for c, k in zip(chunks, known, strict=True)]
        return b"".join(known)

    def decode(self, ids: bytes) -> str:
        """The tokens side by side with a space between, as the library does for a file without a decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next one from 256 on."""
    symbols, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            symbols.append(chr(b))
        else:
            symbols.append(chr(spare))
            spare += 1
    return symbols


_CODERS: dict[int, ForcedBoundaryBpe] = {}


def _coder(file: str) -> ForcedBoundaryBpe:
    """One encoder per vocabulary and worker process."""
    key = hash(file)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = ForcedBoundaryBpe(file)
    return _CODERS[key]


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read once by the driver; its size is that of a vocabulary, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _mapped(df: DataFrame, column: Column, added: dict[str, T.DataType], convert) -> DataFrame:
    """``df`` with the ``added`` columns, computed batch by batch from ``column``; the others only pass through."""
    names = [c for c in df.columns if c.lower() not in {a.lower() for a in added}]
    inner = [f"_c{i}" for i in range(len(names))]  # names may clash or hold dots
    narrow = df.select(*[F.col(f"`{n}`").alias(i) for n, i in zip(names, inner, strict=True)], column.alias("_in"))
    outer = [f"_o{i}" for i in range(len(added))]
    arrow = [pa.binary() if t == T.BinaryType() else pa.string() for t in added.values()]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = convert()
        for batch in small(rows):
            done = [run(x) for x in batch.column(len(inner)).to_pylist()]
            made = [pa.array([d[i] for d in done], t) for i, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*inner, *outer])

    kinds = [T.StructField(o, t) for o, t in zip(outer, added.values(), strict=True)]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in narrow.schema.fields[:-1]], *kinds])
    return narrow.mapInArrow(batches, schema).select(
        *[F.col(i).alias(n) for n, i in zip(names, inner, strict=True)],
        *[F.col(o).alias(a) for o, a in zip(outer, added, strict=True)],
    )


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the token ids of each whole text, as packed little-endian unsigned 32-bit integers.

    Ids equal those of the library without added special tokens, truncation or
    padding. Null text encodes as the empty text, to no ids. With ``decoded`` the
    ids are decoded again into that column, by the same worker. No shuffle; each
    worker remembers the most recent chunks and words (a fixed number of them).
    """
    file = _vocabulary(df, vocabulary)
    added = {out: T.BinaryType()} | ({decoded: T.StringType()} if decoded else {})

    def start():
        coder = _coder(file.value)

        def both(text: str) -> tuple:
            ids = coder.encode(text)
            return (ids, coder.decode(ids)) if decoded else (ids,)

        return both

    return _mapped(df, whole(text_col), added, start)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of packed ids. Null ids decode to the empty text; an unknown id fails."""
    file = _vocabulary(df, vocabulary)

    def start():
        coder = _coder(file.value)
        return lambda ids: (coder.decode(ids),)

    return _mapped(df, F.coalesce(F.col(ids_col), F.lit(b"")), {out: T.StringType()}, start)
