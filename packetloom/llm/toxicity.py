"""Toxicity by a noisy channel: undo leetspeak, spacing and repetition by Viterbi decoding, then score the restored words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.storage import cut_lineage, measured
from packetloom.llm import vectors
from packetloom.llm.columns import whole
from packetloom.llm.packing import small

# --- the channel: what a writer may put in place of a letter, as log probabilities ---
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e",
}
JUNK = set("*#$%&.,-_~^+=|'\"`:;/\\!?<>[](){}")
_LEET_COST, _JUNK_COST, _REPEAT_COST, _ODD_COST, _BLANK_COST = -2.5, -3.0, -2.5, -5.0, -1.0
_EDGES = b".,;:?!\"'()[]{}<>"
#: two or more tokens of at most three characters in a row: blanks between these may be no word boundaries
_SHORT = re.compile(r"(?<!\S)\S{1,3}+(?:\s++\S{1,3}+(?!\S))++")
_RUN, _DOUBLE = re.compile(r"(.)\1\1"), re.compile(r"(.)\1")

# --- the character model: a-z are 1-26, other letters share 27-62, all else is 0 ---
_CODES = 63
_LM_LEXICON_SHARE = 0.02

# --- limits of the classifier, which documents and their number do not change ---
MAX_LEXICON = 2000
FIT_ROWS = 50_000
_MIN_Z = 4.0
_RIDGE = 1.0
#: similarity from which a labelled text is a copy, and texts that are compared with one text in one deal
NEAR, _DEAL = Fraction(4, 5), 256
#: bits that tell which ids may be labelled, in bitmaps of 32768 (what Spark makes of a group)
_BITS, _BITMAP = 1 << 25, 32768
_MEMO = 300_000
_SLICE = 1 << 18


def _code(ch: str) -> int:
    o = ord(ch)
    if 97 <= o <= 122:
        return o - 96
    return 27 + o % 36 if ch.isalpha() else 0


@cache
def _readings(ch: str) -> tuple[list[tuple[str, int, float]], bool, set[str]]:
    """What a character can be read as, with code and cost; whether as junk; the letters it may repeat."""
    found = [(x, _code(x), _LEET_COST) for x in LEET.get(ch, "")]
    found.append((ch, _code(ch), 0.0 if ch.isalpha() else _ODD_COST))
    return found, ch in JUNK, {x for x, _, _ in found}


def plain_word(token: bytes) -> str | None:
    """The word of an ordinary token in lower case, without punctuation at its ends; None if it needs decoding."""
    word = token.strip(_EDGES).decode("utf-8", "replace").lower()
    if word.isalpha():
        return None if _RUN.search(word) else word
    # digits and symbols alone spell nothing
    return None if any(c.isalpha() for c in word) else word


@dataclass
class CharModel:
    """Log probabilities of a character after the two before it, interpolated over three orders."""

    logp: np.ndarray

    @classmethod
    def fit(cls, grams: np.ndarray, words: list[str]) -> CharModel:
        counts = grams.reshape(_CODES, _CODES, _CODES).astype(float) + 1e-3
        if words:
            extra = np.zeros_like(counts)
            for w in words:
                codes = [0, 0, *map(_code, w), 0]
                for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
                    extra[a, b, c] += 1
            counts += extra * (_LM_LEXICON_SHARE * counts.sum() / extra.sum())
        one = counts.sum((0, 1)) / counts.sum()
        two = counts.sum(0)
        two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
        three = (counts + 5 * two[None]) / (counts.sum(2, keepdims=True) + 5)
        return cls(np.log(three))


class Restorer:
    """Viterbi decoding of a token over the lattice of its readings under the character model."""

    def __init__(self, model: CharModel, words: Iterable[str] = (), known: Iterable[str] = ()) -> None:
        self.logp = model.logp.tolist()
        self.words, self.known = frozenset(words), frozenset(known)
        self.kinds = {_kind(w) for w in self.words}
        self.tokens, self.stretches = (_any_of(self.words, blanks) for blanks in ("", " "))

    def decode(self, token: str) -> str:
        """The likeliest intended spelling of ``token``, or of several with blanks between them.

        Every character is read as itself, as a letter it stands for, as junk, or
        as one more copy of the letter before, and a blank as the end of a word
        or as nothing. A state is the last two characters; work is linear in the
        token's length.
        """
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for ch in token.lower():
            if ch == " ":
                ahead = {}
                for (a, b), (score, path) in states.items():
                    ended = score + (self.logp[a][b][0] if b else 0.0)
                    for state, total, way in (((0, 0), ended, (path, " ")), ((a, b), score + _BLANK_COST, path)):
                        if total > ahead.get(state, (-math.inf,))[0]:
                            ahead[state] = (total, way)
                states = ahead
                continue
            readings, junk, spelled = _readings(ch)
            ahead: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in states.items():
                row = self.logp[a][b]
                for x, c, cost in readings:
                    total = score + cost + row[c]
                    if total > ahead.get((b, c), (-math.inf,))[0]:
                        ahead[b, c] = (total, (path, x))
                for skipped, cost in ((junk, _JUNK_COST), (bool(path) and path[1] in spelled, _REPEAT_COST)):
                    if skipped and score + cost > ahead.get((a, b), (-math.inf,))[0]:
                        ahead[a, b] = (score + cost, path)
            states = ahead
        path = max(((s + self.logp[a][b][0], path) for (a, b), (s, path) in states.items()), key=lambda x: x[0])[1]
        out = []
        while path:
            path, x = path
            out.append(x)
        return " ".join(w.strip("".join(JUNK)) for w in "".join(reversed(out)).split(" "))

    def word(self, token: bytes) -> str:
        """The word of one token; doubled letters are looked at where a word of the lexicon can result from them."""
        plain = plain_word(token)
        if plain is None:
            return self.decode(token.decode("utf-8", "replace"))
        if _DOUBLE.search(plain) and plain not in self.words and plain not in self.known and _kind(plain) in self.kinds:
            return self.decode(plain)
        return plain

    def likely(self, parts: list[str], pattern: re.Pattern) -> Iterator[int]:
        """Places of those of ``parts`` of which the channel can make a word of the lexicon: all others are no work."""
        joined = "\n".join(parts).lower().translate(_AS_KIND)
        place, last, at = 0, -1, 0
        for m in pattern.finditer(joined):
            place += joined.count("\n", at, m.start())
            at = m.start()
            if place != last:
                yield place
                last = place

    def text(self, text: str) -> str:
        """The whole text with every token restored and stretches of short tokens decoded together."""
        out, at = [], 0
        for m in _SHORT.finditer(text):
            out += [self.word(t) for t in text[at : m.start()].encode().split()]
            out.append(self.decode(" ".join(m[0].split())))
            at = m.end()
        return " ".join([*out, *(self.word(t) for t in text[at:].encode().split())])


# --- which letters a character can end up as: digits and i, l stand for one kind; symbols that may be junk, blanks and line ends stay ---
_BOTH = {ch: letters for ch, letters in LEET.items() if ch in JUNK}
_AS_KIND = str.maketrans(
    {"l": "i"}
    | {ch: letters[0] for ch, letters in LEET.items() if ch not in JUNK}
    | dict.fromkeys((ch for ch in JUNK if ch not in LEET), "")
    | dict.fromkeys(map(chr, [9, *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]), "")
)


def _kind(word: str) -> str:
    """The word with like letters as one and doubled ones once."""
    return re.sub(r"(.)\1+", r"\1", word.replace("l", "i"))


def _any_of(words: Iterable[str], blanks: str) -> re.Pattern:
    """Matches in every line of :data:`_AS_KIND` from which the channel may make one of ``words``.

    Lines are single tokens, or with ``blanks`` stretches of them. A word begins
    where a token begins and ends where one ends; junk may stand around it.
    """
    trie: dict = {}
    for word in words:
        node = trie
        for ch in _kind(_kind(word).translate(_AS_KIND)):
            node = node.setdefault(ch, {})
        node[""] = {}
    either_way = re.escape("".join(_BOTH))

    def rule(node: dict) -> str:
        either = [f"(?![^\n{blanks}])"] if "" in node else []
        for ch, ahead in sorted(node.items()):
            if ch:
                own = re.escape(ch + "".join(x for x, to in _BOTH.items() if ch in to.replace("l", "i")))
                either.append(f"[{own}][{re.escape(ch)}{either_way}{blanks}]*{rule(ahead)}")
        return f"(?:{'|'.join(either)})"

    return re.compile(f"(?<![^\n{blanks}])[{either_way}]*{rule(trie)}" if trie else r"(?!)")


@dataclass
class ToxicityModel:
    """What scoring needs: the character model, and a weight for each word of a lexicon of bounded size."""

    chars: CharModel
    weights: dict[str, float]
    bias: float
    #: ordinary words that differ from one of the lexicon in doubled letters only
    known: tuple[str, ...] = ()


class Scorer:
    """Scores texts in one worker; remembers the weight of a fixed number of recent tokens."""

    def __init__(self, model: ToxicityModel) -> None:
        self.restorer = Restorer(model.chars, model.weights, model.known)
        self.words = list(model.weights)
        self.weights = list(model.weights.values())
        self.index = {w: i for i, w in enumerate(self.words)}
        self.bias = model.bias
        self.seen: tuple[set, set] = (set(), set())
        self.held: tuple[dict, dict] = ({}, {})

    def found(self, text: str) -> set[int]:
        """Which words of the lexicon the restored text has."""
        tokens, stretches = set(text.encode().split()), set(_SHORT.findall(text))
        known: set[int] = set()
        for kind, parts in enumerate((tokens, stretches)):
            seen, held = self.seen[kind], self.held[kind]
            new = list(parts - seen)
            if len(seen) + len(new) > _MEMO:
                seen.clear()
                held.clear()
                new = list(parts)
            seen.update(x for x in new if len(x) <= 64)
            known.update(*(held[x] for x in parts & held.keys()))
            if not new:
                continue
            for x, at in self._of_stretches(new) if kind else self._of_tokens(new):
                known |= at
                if len(x) <= 64:
                    held[x] = at
        return known

    def _of_tokens(self, tokens: list[bytes]) -> Iterator[tuple[bytes, set[int]]]:
        """The tokens that are words of the lexicon, with these."""
        for i in self.restorer.likely(b"\n".join(tokens).decode().split("\n"), self.restorer.tokens):
            at = self.index.get(self.restorer.word(tokens[i]))
            if at is not None:
                yield tokens[i], {at}

    def _of_stretches(self, stretches: list[str]) -> Iterator[tuple[str, set[int]]]:
        """The stretches of short tokens that have words of the lexicon when decoded, with these."""
        joined = [" ".join(x.split()) for x in stretches]
        for i in self.restorer.likely(joined, self.restorer.stretches):
            at = {self.index[w] for w in self.restorer.decode(joined[i]).split(" ") if w in self.index}
            if at:
                yield stretches[i], at

    def score(self, text: str) -> float:
        x = self.bias + sum(self.weights[i] for i in sorted(self.found(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _joined(texts: list[str]) -> Iterator[str]:
    """The texts with two boundaries before each and one at the end, some ``_SLICE`` characters at a time."""
    own: list[str] = []
    size = 0
    for text in texts:
        own.append(text)
        size += len(text)
        if size >= _SLICE:
            yield "  " + "  ".join(own) + " "
            own, size = [], 0
    if own:
        yield "  " + "  ".join(own) + " "


def _trigrams(texts: DataFrame) -> np.ndarray:
    """Counts of character trigrams of all texts; at most 63^3 numbers leave the job."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(0x3000, np.uint32)
        for o in range(0x3000):
            low = chr(o).lower()
            table[o] = _code(low) if len(low) == 1 else 0
        total = np.zeros(_CODES**3, np.int64)
        for batch in small(rows):
            for text in _joined(batch.column(0).to_pylist()):
                points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
                c = np.where(points < 0x3000, table[np.minimum(points, 0x2FFF)], 27 + points % 36)
                # a word's first letter follows two boundaries
                prior = np.where(c[1:-1] == 0, 0, c[:-2])
                seen = (prior * _CODES + c[1:-1]) * _CODES + c[2:]
                used = ~((c[1:-1] == 0) & (c[2:] == 0))
                total += np.bincount(seen[used], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["gram", "n"])

    counted = texts.mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = np.zeros(_CODES**3, np.int64)
    for row in counted.collect():
        grams[row["gram"]] = row["n"]
    return grams


def _lexicon(labelled: DataFrame) -> tuple[list[str], list[str]]:
    """Words that mark toxic documents: log-odds at least ``_MIN_Z`` standard errors above 0, counted over all rows.

    Also the words of three or more clean documents, and not oftener in toxic
    ones, that differ from one of them in doubled letters only.
    """

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in rows:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[toxic].update({w for t in set(unpack(text).split()) if (w := plain_word(t)) and len(w) <= 64})
            words = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), *[pa.array([s[w] for w in words], pa.int64()) for s in seen]],
                ["word", "clean", "toxic"],
            )

    totals = labelled.groupBy("toxic").count().collect()
    of = {r["toxic"]: float(r["count"]) for r in totals}
    if not of.get(0) or not of.get(1):
        return [], []
    n1, n0 = F.col("n1") + 0.5, F.col("n0") + 0.5
    z = (F.log(n1 / (of[1] + 1 - n1)) - F.log(n0 / (of[0] + 1 - n0))) / F.sqrt(1 / n1 + 1 / n0)
    counted = cut_lineage(
        labelled.select("_text", "toxic")
        .mapInArrow(count, "word string, clean long, toxic long")
        .groupBy("word")
        .agg(F.sum("clean").alias("n0"), F.sum("toxic").alias("n1"))
        .where("n1 >= 3 or (n0 >= 3 and word rlike '(.)\\\\1')")
    )
    words = (
        counted.where("n1 >= 3")
        .select("word", z.alias("z"))
        .where(F.col("z") >= _MIN_Z)
        .orderBy(F.desc("z"), "word")
        .limit(MAX_LEXICON)
    )
    found = [r["word"] for r in words.collect()]
    kind = F.regexp_replace(F.translate("word", "l", "i"), r"(.)\1+", "$1")
    usual = counted.where("n0 >= 3").where(F.col("n0") / of[0] >= F.col("n1") / of[1]).where(kind.isin({_kind(w) for w in found}))
    return found, [r["word"] for r in usual.select("word").collect()]


def _logistic(found: list[list[int]], labels: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on sparse 0/1 features.

    Each step minimizes an upper bound of the loss in which features are apart,
    so it never overshoots, however many words occur together.
    """
    sizes = np.array([len(f) + 1 for f in found])
    row = np.repeat(np.arange(len(found)), sizes - 1)
    col = np.array([i for f in found for i in f], np.int64)
    bend = 0.25 * np.bincount(col, sizes[row], size) + _RIDGE
    w, bias = np.zeros(size), math.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    for _ in range(600):
        x = bias + np.bincount(row, w[col], len(found))
        error = labels - 1 / (1 + np.exp(-np.clip(x, -50, 50)))
        w += (np.bincount(col, error[row], size) - _RIDGE * w) / bend
        bias += error.sum() / (0.25 * sizes.sum())
    return w, bias


def _keyed(rows: DataFrame) -> DataFrame:
    """The ``rows`` with a 128-bit hash of the five-word shingles of ``_text``, their last column, and ``_key``, the smallest of these.

    Near copies mostly share the key, but so do texts with a passage in common.
    The text is compressed, as it is shuffled and written next.
    """

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in small(batches):
            keys, h1, h2, packed = [], [], [], []
            for text in batch.columns[-1].to_pylist():
                shingles = vectors.shingle_sets([text.encode()], 5)[0]
                keys.append(int(shingles[0].view(np.int64)) if len(shingles) else 0)
                h1.append(int(vectors.mix(shingles).sum().view(np.int64)))
                h2.append(int(vectors.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64)))
                packed.append(compress(text.encode()))
            added = [pa.array(packed, pa.binary()), *[pa.array(c, pa.int64()) for c in (keys, h1, h2)]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], [*batch.schema.names, "_key", "_h1", "_h2"])

    new = [T.StructField("_text", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("_key", "_h1", "_h2")]]
    return rows.mapInArrow(smallest, T.StructType([*rows.schema.fields[:-1], *new]))


def _without_copies(labelled: DataFrame) -> DataFrame:
    """The rows of :func:`_keyed` without those that a row of the same label stands for.

    Of texts with equal shingle sets the smallest id stands for all. Where
    several sets share a key, those with a Jaccard similarity of at least
    ``NEAR`` with the set of the smallest id are left out; all others stay.

    Ids and hashes are judged apart from the texts, of which only those that are
    compared or have an id (or its bit) of a copy are shuffled.
    """
    own = ["_key", "toxic", "_h1", "_h2"]
    firsts = cut_lineage(labelled.groupBy(*own).agg(F.min("_id").alias("_id")))
    groups = (
        firsts.groupBy("_key", "toxic")
        .agg(F.min(F.struct("_id", "_h1", "_h2")).alias("first"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
        # a key of many rows is dealt to several tasks
        .withColumn("deals", F.ceil(F.col("size") / _DEAL))
    )
    groups = cut_lineage(groups)
    leader = groups.select("_key", "toxic", "first.*", "deals")
    leads = leader.join(_may_be_in(labelled, leader), [*own, "_id"]).groupBy("_key", "toxic", "deals").agg(F.min("_text").alias("_lead"))
    dealt = leads.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).drop("deals")
    others = cut_lineage(firsts.join(groups.select("_key", "toxic", "deals", F.col("first._id").alias("_first")), ["_key", "toxic"]).where("_id <> _first"))
    texts = _may_be_in(labelled, others).join(others, [*own, "_id"]).withColumn("deal", F.pmod(F.xxhash64("_id"), "deals"))
    pairs = texts.join(dealt, ["_key", "toxic", "deal"]).select("_id", "toxic", "_h1", "_h2", "_text", "_lead")

    def near(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small(rows):
            keep = []
            for text, lead in zip(*(batch.column(i).to_pylist() for i in (4, 5)), strict=True):
                x, y = (vectors.shingle_sets([unpack(t)], 5)[0] for t in (text, lead))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * NEAR.denominator >= (len(x) + len(y) - both) * NEAR.numerator and both > 0)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    kind = T.StructType(pairs.schema.fields[:4])
    copies = pairs.mapInArrow(near, kind).distinct()
    one = ["_id", "toxic", "_h1", "_h2"]
    kept = firsts.join(copies, one, "left_anti")
    left_out = cut_lineage(labelled.select(*one).join(kept, one, "left_anti").distinct())
    marked = _marked(labelled, left_out)
    judged = marked.where("_may").join(left_out, one, "left_anti")
    return marked.where("not _may").unionByName(judged.select(*marked.columns)).drop("_may")


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` with ``_may``: true if ``_id`` is among ``ids``, and for some others, whose hash has the bit of one of them.

    The bits take 4 MB at most, whatever the number of ids, and are sent to every
    worker; so a join that follows need not shuffle the texts of most other rows.
    Ids that a join would compare as another type are all marked.
    """
    one, other = (x.schema["_id"].dataType for x in (rows, ids))
    if not (one == other == T.StringType() or isinstance(one, T.IntegralType) and isinstance(other, T.IntegralType)):
        return rows.withColumn("_may", F.lit(True))
    # equal numbers of two types have different hashes
    hashed = F.pmod(F.xxhash64("_id" if one == other else F.col("_id").cast("long")), F.lit(_BITS))
    at = F.pmod(hashed, F.lit(_BITMAP))
    bits = ids.select(F.floor(hashed / _BITMAP).alias("_part"), at.alias("_at")).groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    # made once, however often the rows are read
    bits = cut_lineage(bits)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumns({"_part": F.floor(hashed / _BITMAP), "_at": at})
    may = F.coalesce(F.getbit(byte, F.pmod("_at", F.lit(8)).cast("int")) == 1, F.lit(False))
    return placed.join(F.broadcast(bits), "_part", "left").select(*rows.columns, may.alias("_may"))


def _may_be_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose ``_id`` is among ``ids``, and some others (:func:`_marked`)."""
    return _marked(rows, ids).where("_may").drop("_may")


def _labelled(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of :func:`_keyed` of the ``texts`` joined with the different ones of ``marks``, labels 0 and 1 by ``_id``, and written.

    Bits tell the label of nearly every id, so texts stay where they are read. A
    pass over the ids alone finds those for which the bits are wrong or tell both
    labels; only texts with the bit of one of these are shuffled to meet ``marks``.
    """
    told = _marked(texts, marks.where("toxic = 0")).withColumnRenamed("_may", "_clean")
    told = _marked(told, marks.where("toxic = 1")).withColumnRenamed("_may", "_toxic").where("_clean OR _toxic")
    told = told.select("_id", F.expr("CASE WHEN _clean <> _toxic THEN int(_toxic) END").alias("_guess"), "_text")
    known = marks.select("_id").distinct().withColumn("_known", F.lit(True))
    ids = told.select("_id", "_guess").dropDuplicates(["_id"]).join(known, "_id", "left")
    unsure = cut_lineage(ids.where("_guess IS NULL OR _known IS NULL").select("_id"))
    keyed = measured(_keyed(_marked(told, unsure).select("_id", "_guess", "_may", "_text")))
    joined = measured(keyed.where("_may").drop("_guess", "_may").join(marks.distinct(), "_id"))
    return keyed.where("NOT _may").withColumnRenamed("_guess", "toxic").drop("_may").unionByName(joined)


def _smallest_order(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the smallest ``_order``, a hash, and those that tie with the last of them; no row is moved for it."""
    top = F.shiftright("_order", 48)
    before = 0
    for part in sorted(rows.groupBy(top.alias("top")).count().collect(), key=lambda r: r["top"]):
        if before + part["count"] >= n:
            # a 65536th of the numbers
            orders = sorted(r["_order"] for r in rows.where(top == part["top"]).select("_order").collect())
            return rows.where(F.col("_order") <= orders[n - before - 1])
        before += part["count"]
    return rows


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id") -> ToxicityModel:
    """Learn from the ``docs`` that ``labels`` marks 0 or 1, with character counts of all ``docs``.

    Of verified copies with the same label (:func:`_without_copies`) only one
    counts, else the words of a much copied toxic text would look toxic. Labelled
    texts are written once, compressed (:func:`_labelled`); word counts cover all that are no copies. Only the weights are fitted on a sample: the ``FIT_ROWS`` rows with the
    smallest hash of their id. The lexicon holds at most ``MAX_LEXICON`` words.
    Rows without a label or an id are ignored; without both classes every score
    is the same.
    """
    texts = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1)")
    rows = _without_copies(_labelled(texts, marks)).select("_text", "toxic", F.xxhash64("_id").alias("_order"))
    words, usual = _lexicon(rows)
    chars = CharModel.fit(_trigrams(docs.select(whole(text_col))), words)
    if not words:
        toxic = rows.agg(F.avg("toxic")).first()[0] or 0.0
        return ToxicityModel(chars, {}, math.log((toxic + 1e-3) / (1 - toxic + 1e-3)))
    start = ToxicityModel(chars, dict.fromkeys(words, 0.0), 0.0, tuple(usual))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, unpack = Scorer(start), zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            found = [sorted(scorer.found(unpack(t).decode())) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["found", "toxic"])

    # the sample is chosen by ids alone, so only its texts are read as features
    sample = _smallest_order(rows, FIT_ROWS).select("_text", "toxic").repartition(16)
    fitted = sample.mapInArrow(features, "found array<int>, toxic int").collect()
    weights, bias = _logistic([r["found"] for r in fitted], np.array([r["toxic"] for r in fitted], float), len(words))
    return ToxicityModel(chars, dict(zip(words, weights.tolist(), strict=True)), bias, tuple(usual))


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score", restored: str | None = None) -> DataFrame:
    """Add the probability that each whole text is toxic, and with ``restored`` its restored text.

    Null text counts as empty; the empty text gets the model's bias. All other
    columns pass through; one named like a result gives way. No shuffle; the
    model's size is fixed, so sending it to every worker is safe.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    taken = {out.lower(), (restored or out).lower()}
    names = [c for c in df.columns if c.lower() not in taken]
    inner = [f"_c{i}" for i in range(len(names))]
    narrow = df.select(*[F.col(f"`{n}`").alias(i) for n, i in zip(names, inner, strict=True)], whole(text_col).alias("_in"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in small(rows):
            texts = batch.column(len(inner)).to_pylist()
            scores = pa.array([scorer.score(t) for t in texts], pa.float64())
            clean = pa.array([scorer.restorer.text(t) if restored else None for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores, clean], [*inner, "_out", "_clean"])

    schema = T.StructType(
        [*narrow.schema.fields[:-1], T.StructField("_out", T.DoubleType()), T.StructField("_clean", T.StringType())]
    )
    scored = narrow.mapInArrow(run, schema)
    return scored.select(
        *[F.col(i).alias(n) for n, i in zip(names, inner, strict=True)],
        F.col("_out").alias(out),
        *([F.col("_clean").alias(restored)] if restored else []),
    )
