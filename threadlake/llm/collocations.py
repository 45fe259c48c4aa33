"""Collocations from FM-indexes over word ids.

Each task cuts its texts into shards of bounded bytes, one language each.
Words are counted over all shards; words below the least count can't be in a
frequent phrase, so they become breaks.  Each shard then gets a bidirectional
FM-index over the ids of its frequent words: the Burrows-Wheeler transforms of
its sequence and of the reversed one, sorted by as many words as the phrases
are long less one.  Phrases are enumerated by extending intervals of the index,
by turns to the right and to the left, and their counts are summed across the
shards.  A phrase is extended only if its parts are frequent in all shards
together, by a bit filter of fixed size, which may let some others pass; the
sums decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.scratch import Scratch
from threadlake.llm.words import mix

#: Bytes of text in a shard, and of all texts that a task holds back for its shards.
SHARD_BYTES, WAIT_BYTES = 6 << 20, 16 << 20
#: Bytes whose words are cut at once (one single text is never cut).
STEP_BYTES = 1 << 20
#: log2 of the bits of the filter of frequent phrases (8 MB), and the bits set by one of them.
FILTER_BITS, FILTER_HASHES = 26, 2
#: Parts that a language's phrases are ranked in before they are ranked together.
RANK_PARTS = 64

#: A-Z lower-cased, the bytes that end a piece as \n, tab as blank.
_BYTES = bytearray(bytes(range(256)).lower())
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _BYTES[_c] = 0x0A
_BYTES[0x09] = 0x20
_BYTES = bytes(_BYTES)


# --------------------------------------------------------------------------------------------------------- the index

@dataclass
class Intervals:
    """Phrases (rows of symbols) with their intervals in both halves of an index."""

    phrases: np.ndarray
    forward: np.ndarray
    backward: np.ndarray
    size: np.ndarray

    def where(self, keep: np.ndarray) -> Intervals:
        return Intervals(self.phrases[keep], self.forward[keep], self.backward[keep], self.size[keep])


def transform(seq: np.ndarray, depth: int) -> np.ndarray:
    """The Burrows-Wheeler transform of a cyclic sequence, its rows sorted by their first ``depth`` symbols."""
    rank = seq.astype(np.int64)
    for _ in range(depth - 1):
        _, rank = np.unique(rank, return_inverse=True)
        rank = seq.astype(np.int64) * (int(rank.max(initial=0)) + 1) + np.roll(rank, -1)
    return seq[np.argsort(rank, kind="stable") - 1]


class Index:
    """Bidirectional FM-index of a sequence of symbols 0 to sigma - 1, where 0 is a break that no phrase spans.

    ``forward`` and ``backward`` are the transforms of the sequence and of its
    reverse.  Intervals of phrases of up to ``depth`` symbols can be extended.
    """

    def __init__(self, forward: np.ndarray, backward: np.ndarray) -> None:
        self.bwt = {True: forward, False: backward}
        self.sigma = int(forward.max(initial=0)) + 1
        self.steps: dict[bool, np.ndarray] = {}
        counts = np.bincount(forward, minlength=self.sigma)
        self.start = np.cumsum(counts) - counts
        self.counts = counts

    @classmethod
    def build(cls, seq: np.ndarray, depth: int) -> Index:
        return cls(transform(seq, depth), transform(seq[::-1], depth))

    def _step(self, left: bool) -> np.ndarray:
        """Row of each row's preceding symbol: where its symbol's block starts, and how many of it came before."""
        if left not in self.steps:
            bwt = self.bwt[left]
            step = np.empty(len(bwt), np.int64)
            step[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
            self.steps[left] = step
        return self.steps[left]

    def words(self) -> Intervals:
        """The single symbols."""
        s = np.flatnonzero(self.counts)
        s = s[s > 0]
        return Intervals(s[:, None], self.start[s], self.start[s], self.counts[s])

    def extend(self, of: Intervals, left: bool) -> Intervals:
        """Every phrase one symbol longer, to the left or to the right, that stands in the sequence."""
        bwt, step = self.bwt[left], self._step(left)
        here, there = (of.forward, of.backward) if left else (of.backward, of.forward)
        owner = np.repeat(np.arange(len(of.size)), of.size)
        row = np.arange(len(owner)) + np.repeat(here - (np.cumsum(of.size) - of.size), of.size)
        symbol = bwt[row].astype(np.int64)
        keep = symbol > 0
        owner, row, symbol = owner[keep], row[keep], symbol[keep]
        key = owner * self.sigma + symbol
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
        size = np.diff(np.r_[first, len(key)])
        owner, symbol = owner[order][first], symbol[order][first]
        mine = step[row[order][first]]
        # in the other half the phrase's interval is cut by the symbols in their order, breaks first
        broken = of.size - np.bincount(owner, size, len(of.size)).astype(np.int64)
        before = np.cumsum(size) - size
        at = np.searchsorted(owner, owner)  # the first extension of the same phrase
        other = there[owner] + broken[owner] + before - before[at]
        parts = [symbol[:, None], of.phrases[owner]] if left else [of.phrases[owner], symbol[:, None]]
        return Intervals(np.hstack(parts), mine if left else other, other if left else mine, size)


def enumerate_phrases(index: Index, length: int, passes: Callable[[np.ndarray], np.ndarray] | None = None) -> Intervals:
    """All phrases of ``length`` symbols; ``passes`` tells which shorter phrases (rows) may stand in them."""
    found = index.words()
    for n in range(2, length + 1):
        left = n % 2 == 1
        found = index.extend(found, left)
        if passes:  # at the last step, the part that is not known yet
            shorter = found.phrases if n < length else found.phrases[:, :-1] if left else found.phrases[:, 1:]
            found = found.where(passes(shorter))
    return found


# ------------------------------------------------------------------------------------------------- texts to shards

def _cut(texts: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Ids of the words of texts (new ones get the next id), 0 for the ends of pieces and texts."""
    out, at = [np.zeros(1, np.int32)], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= STEP_BYTES):
            size += len(texts[end])
            end += 1
        parts = b"\n".join(texts[at:end]).translate(_BYTES).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter((known.setdefault(w, len(known)) for w in parts), np.int32, len(parts))
        out += [ids[ids > 0] - 1, np.zeros(1, np.int32)]
        at = end
    return np.concatenate(out)


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, dtype: str = "<i4") -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _shard(number: int, lang: str, texts: list[bytes]) -> pa.RecordBatch:
    known = {b"": 0, b"\n": 1}
    ids = _cut(texts, known)  # 0: a break; word w has id known[w] - 1
    counts = np.bincount(ids, minlength=len(known) - 1)[1:]
    words = list(known)[2:]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([lang]), pa.array([int(counts.sum())], pa.int64()), pa.array([[w.decode() for w in words]], pa.list_(pa.string())),
         pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([_packed(ids.astype("<i4"))], pa.binary())],
        ["shard", "lang", "n", "words", "counts", "length", "ids"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a task, gathered per language into shards."""
    wait: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    total, number = 0, TaskContext.get().partitionId() << 32

    def flush(lang: str) -> pa.RecordBatch:
        nonlocal total, number
        total, number = total - size.pop(lang), number + 1
        return _shard(number - 1, lang, wait.pop(lang))

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            data = text.as_buffer() if text.is_valid else None
            if data is None or not data.size:
                continue
            wait.setdefault(lang, []).append(data.to_pybytes())
            size[lang] = size.get(lang, 0) + data.size
            total += data.size
            if size[lang] >= SHARD_BYTES:
                yield flush(lang)
            elif total >= WAIT_BYTES:
                yield flush(max(size, key=size.get))
    for lang in list(wait):
        yield flush(lang)


_SHARD = "shard long, lang string, n long, words array<string>, counts array<long>, length long, ids binary"
_INDEX = "length long, forward binary, backward binary, globals binary, symbols long"


def _index(depth: int) -> Callable:
    def run(shard: pa.Table, known: pa.Table) -> pa.Table:
        """One shard with the global ids of its frequent words: symbols in the order of these ids, and the index over them."""
        if not shard.num_rows or not known.num_rows:
            return pa.table({"length": pa.array([], pa.int64()), "forward": pa.array([], pa.binary()), "backward": pa.array([], pa.binary()),
                             "globals": pa.array([], pa.binary()), "symbols": pa.array([], pa.int64())})
        local, names = known.column("local").to_numpy(), known.column("word_id").to_numpy()
        order = np.argsort(names)
        ids = _unpacked(shard.column("ids")[0].as_py(), shard.column("length")[0].as_py())
        symbol = np.zeros(int(max(ids.max(), local.max() + 1)) + 1, np.int32)
        symbol[local[order] + 1] = np.arange(1, len(order) + 1)
        seq = symbol[ids]
        seq = seq[np.r_[True, (seq[1:] > 0) | (seq[:-1] > 0)]]  # one break where many stand together
        return pa.table({"length": pa.array([len(seq)], pa.int64()), "forward": pa.array([_packed(transform(seq, depth).astype("<i4"))], pa.binary()),
                         "backward": pa.array([_packed(transform(seq[::-1], depth).astype("<i4"))], pa.binary()),
                         "globals": pa.array([_packed(names[order].astype("<i8"))], pa.binary()), "symbols": pa.array([len(order)], pa.int64())})
    return run


# -------------------------------------------------------------------------------------------- phrases of all shards

def _bits(phrases: np.ndarray) -> list[np.ndarray]:
    """Positions in the filter of phrases (rows of global ids)."""
    h = np.zeros(len(phrases), np.uint64)
    for k in range(phrases.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + phrases[:, k].astype(np.uint64) + np.uint64(k + 1))
    return [(mix(h + np.uint64(k)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) for k in range(FILTER_HASHES)]


def _mark(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = np.concatenate(_bits(np.stack([b.column(f"w{k}").to_numpy() for k in range(1, length + 1)], axis=1)))
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.left_shift(np.int64(1), bit & 63))], ["cell", "bits"])
    return run


def bit_filter(phrases: DataFrame, length: int) -> np.ndarray:
    """The bit filter of phrases (w1 .. w<length>), as 64-bit cells: at most 2^FILTER_BITS bits, however many phrases there are."""
    cells = phrases.select(*_names(length)).mapInArrow(_mark(length), "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return out


def _names(length: int) -> list[str]:
    return [f"w{k}" for k in range(1, length + 1)]


def _phrases(length: int, filters: dict) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                names = np.r_[0, _unpacked(r["globals"], r["symbols"], "<i8")]
                index = Index(_unpacked(r["forward"], r["length"]), _unpacked(r["backward"], r["length"]))

                def passes(phrases: np.ndarray, names: np.ndarray = names) -> np.ndarray:
                    cells = filters[phrases.shape[1]].value
                    ok = np.ones(len(phrases), bool)
                    for bit in _bits(names[phrases]):
                        ok &= (cells[bit >> 6] >> (bit & 63) & 1).astype(bool)
                    return ok

                found = enumerate_phrases(index, length, passes if length > 2 else None)
                del index
                for lo in range(0, len(found.size), 1 << 17):
                    part = names[found.phrases[lo:lo + (1 << 17)]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(part[:, k]) for k in range(length)), pa.array(found.size[lo:lo + (1 << 17)])], [*_names(length), "n"])
    return run


def _cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 10^15."""
    big = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big(a) * big(a)), big(left) * big(right))


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, top: int = 2000) -> DataFrame:
    """Each language's phrases of 2 to ``max_words`` words by how much more often they stand together than their parts.

    ``docs``: lang string, text string; other columns, whatever their names,
    are ignored.  A null lang is ``und``, a null or empty text holds nothing,
    repeated rows count each; an empty table gives an empty result.  Texts
    (A-Z lower-cased) end pieces at ``[.,;:!?\\n\\v\\f\\r]``; words are what
    stands between blanks and tabs.  A phrase lies within a piece; candidates
    have a count a of ``min_count`` or more.  The lowest score
    floor(10^6 a^2 / (l r)) over the cuts into two parts counts (ties: the
    earliest cut); a candidate goes if a longer candidate around it has at least
    half its count.  Ties in rank: the larger a, then the phrase in byte order.

    Returns lang, rank, phrase, a, l, r, n, score (n: all words of the lang).
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "collocations")
    depth = max(1, max_words - 1)
    x = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    shards = scratch.keep(x.mapInArrow(_shards, _SHARD), "shards")
    each = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e")).select("lang", F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    counted = each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    words = scratch.keep(counted.withColumn("word_id", F.monotonically_increasing_id()), "words")
    stands = shards.select("shard", "lang", F.posexplode("words").alias("local", "word")).join(words.select("lang", "word", "word_id"), ["lang", "word"]).select(F.col("shard").alias("of"), "local", "word_id")
    index = shards.select("shard", "length", "ids").groupBy("shard").cogroup(stands.groupBy("of")).applyInArrow(_index(depth), _INDEX)
    index = scratch.keep(index, "index")

    grams: dict[int, DataFrame] = {}
    filters: dict = {}
    for length in range(2, max_words + 1):
        found = index.mapInArrow(_phrases(length, filters), ", ".join(f"{w} long" for w in [*_names(length), "n"]))
        found = found.groupBy(*_names(length)).agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
        grams[length] = scratch.keep(found, f"grams-{length}")
        if length < max_words:
            filters[length] = spark.sparkContext.broadcast(bit_filter(grams[length], length))  # 8 MB at any size
    ranked = None
    for length in range(2, max_words + 1):
        scored = _scored(grams, words, length, max_words)
        ranked = scored if ranked is None else ranked.unionByName(scored)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    best = ranked.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    out = best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    out = scratch.keep(out, "result")
    scratch.drop("shards", "words", "index", *(f"grams-{k}" for k in range(2, max_words + 1)))
    return out


def _scored(grams: dict[int, DataFrame], words: DataFrame, length: int, max_words: int) -> DataFrame:
    """Candidates of one length that no longer one stands for: lang, phrase, a, l, r, score."""
    names = _names(length)
    x = grams[length].withColumnRenamed("f", "a")
    if length < max_words:
        longer, its = grams[length + 1], _names(length + 1)
        around = longer.select(*(F.col(w) for w in its[:-1]), "f").union(longer.select(*(F.col(w) for w in its[1:]), "f")).toDF(*names, "f")
        around = around.groupBy(*names).agg(F.max("f").alias("longest"))
        x = x.join(around, names, "left").where("longest is null or 100 * longest < 50 * a").drop("longest")
    for w in names:
        x = x.join(words.select(F.col("word_id").alias(w), F.col("word").alias(f"{w}_word"), F.col("f").alias(f"{w}_f"), *([F.col("lang")] if w == "w1" else [])), w)
    cuts = []
    for k in range(1, length):
        sides = []
        for side, part in (("l", names[:k]), ("r", names[k:])):
            if len(part) > 1:
                x = x.join(grams[len(part)].toDF(*part, f"{side}{k}"), part)
            sides.append(F.col(f"{side}{k}" if len(part) > 1 else f"{part[0]}_f"))
        cuts.append(F.struct(_cut_score(F.col("a"), *sides).alias("score"), F.lit(k).alias("k"), sides[0].alias("l"), sides[1].alias("r")))
    cut = F.array_min(F.array(*cuts))
    phrase = F.concat_ws(" ", *(F.col(f"{w}_word") for w in names))
    return x.select("lang", phrase.alias("phrase"), "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
