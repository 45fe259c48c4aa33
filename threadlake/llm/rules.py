"""Quality rules: rule statistics of whole texts, and an isolation forest on them.

The forest cuts the space of the statistics by random splits; a document that
few splits set apart is unusual.  Its trees grow on a bounded sample of
labelled rows; the path length beyond which a document is rejected is
calibrated on all labelled rows, by a histogram of their scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm import words as W
from threadlake.llm.scratch import Scratch

SYMBOLS = b"#*$%&|<>"
#: Labelled rows that the trees are grown from, trees, rows a tree sees.
SAMPLE_ROWS, TREES, TREE_ROWS = 20_000, 128, 256
#: Rows of a tree that are labelled bad: enough for splits to reach out to them, too few to look like a crowd of their own.
TREE_BAD = 4
#: Bins of the score histogram.
BINS = 4096
#: Most good labelled rows that the calibrated threshold may reject.
LOSS = 0.002

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits"]
_STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _member(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


_SYMBOL, _UPPER, _DIGIT, _MARK = _member(SYMBOLS), _member(bytes(range(65, 91))), _member(b"0123456789"), _member(b"!?")
_LINE = ~_member(b"\n")


def _per_row(m: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(m)])[off])


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more, found before) for each key."""
    o = np.argsort(key, kind="stable")
    eq = key[o][1:] == key[o][:-1]
    twice, before = np.zeros(len(key), bool), np.zeros(len(key), bool)
    before[o[1:][eq]] = twice[o[1:][eq]] = True
    twice[o[:-1][eq]] = True
    return twice, before


def text_counts(buf: np.ndarray, off: np.ndarray, k: int = 5) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each row."""
    rows = len(off) - 1
    s, e, first = W.spans(buf, off, W.NON_SPACE)
    h = W.hashes(buf, s, e)
    out = {"n_words": np.diff(first)}
    out["word_chars"] = _per_row(W.NON_SPACE[buf] & ((buf & 0xC0) != 0x80), off)
    out |= {c: _per_row(m[buf], off) for c, m in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_marks", _MARK), ("n_digits", _DIGIT))}
    ls, le, lfirst = W.spans(buf, off, _LINE)
    worded = np.searchsorted(s, le) > np.searchsorted(s, ls)
    row = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(lfirst))
    key = W.mix(W.hashes(buf, ls, le) + row * np.uint64(0x9E3779B97F4A7C15))
    _, before = _again(key[worded])
    at = row[worded].astype(np.int64)
    out["n_lines"] = np.bincount(at, minlength=rows)
    out["n_dup_lines"] = np.bincount(at[before], minlength=rows)
    row = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(first))
    hit = np.zeros(len(h), bool)
    if len(h) >= k:
        inside = row[k - 1:] == row[:len(row) - k + 1]
        key = W.mix(W.windows(h, k) + row[:len(row) - k + 1] * np.uint64(0x9E3779B97F4A7C15))[inside]
        twice = np.flatnonzero(inside)[_again(key)[0]]
        for i in range(k):
            hit[twice + i] = True
    out["n_repeat_words"] = np.bincount(row[hit].astype(np.int64), minlength=rows)
    return out


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, buf, off in W.slices(b.column("text")):
            c = text_counts(buf, off)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *(pa.array(c[x].astype(np.int64)) for x in COUNTS)], ["doc_id", *COUNTS])


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """The statistics that the forest splits, as shares.

    Each share counts a few ordinary words more than the text has, so that one
    number or name in a short text doesn't look like a habit of it.
    """
    n = c["n_words"] + 20.0
    chars = c["word_chars"] + 100.0
    return np.stack([
        chars / n, np.log1p(10 * c["n_symbols"] / n), np.log1p(10 * c["n_marks"] / n), c["n_upper"] / chars,
        c["n_repeat_words"] / n], axis=1)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Isolation trees as arrays: feature (-1: leaf), cut, children, and the path length at leaves."""

    def __init__(self, x: np.ndarray, bad: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        good, bad = np.flatnonzero(~bad), np.flatnonzero(bad)
        some = min(TREE_BAD, len(bad))
        self.rows = min(rows, len(good)) + some
        self.trees = []
        limit = max(1, int(np.ceil(np.log2(max(self.rows, 2)))))
        for _ in range(trees if len(x) else 0):
            nodes: list[list[float]] = []
            pick = np.concatenate([rng.choice(good, self.rows - some, replace=False), rng.choice(bad, some, replace=False)])
            self._grow(x[pick], 0, limit, nodes, rng)
            self.trees.append(np.array(nodes))
        self.limit = limit

    def _grow(self, x: np.ndarray, depth: int, limit: int, nodes: list, rng: np.random.Generator) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + _expected(len(x))])
        lo, hi = x.min(0), x.max(0)
        wide = np.flatnonzero(hi > lo)
        if depth < limit and len(x) > 1 and len(wide):
            f = int(rng.choice(wide))
            cut = float(rng.uniform(lo[f], hi[f]))
            left = x[:, f] < cut
            if left.any() and not left.all():
                a = self._grow(x[left], depth + 1, limit, nodes, rng)
                b = self._grow(x[~left], depth + 1, limit, nodes, rng)
                nodes[at] = [f, cut, a, b, 0.0]
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 is unusual, 0.5 and below is ordinary; 0 without a tree."""
        if not self.trees:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        r = np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.limit):
                f = t[at, 0].astype(np.int64)
                at = np.where(f < 0, at, np.where(x[r, f] < t[at, 1], t[at, 2], t[at, 3]).astype(np.int64))
            total += t[at, 4]
        return np.exp2(-total / len(self.trees) / max(_expected(self.rows), 1e-9))


def _scores(forest) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {x: np.asarray(b.column(x)) for x in COUNTS}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.value.score(features(c)))], [*b.schema.names, "score"])
    return run


def threshold(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, loss: float) -> float:
    """The score from which documents are rejected: it rejects most bad rows, but at most ``loss`` of the good ones.

    2 (nothing is rejected) without good or bad rows.
    """
    if not good.sum() or not bad.sum():
        return 2.0
    o = np.argsort(bins)[::-1]
    lost, caught = np.cumsum(good[o]) / good.sum(), np.cumsum(bad[o]) / bad.sum()
    gain = np.where(lost <= loss, caught - lost, -1)
    k = int(gain.argmax())
    return float(bins[o][k]) / BINS if gain[k] > 0 else 2.0


def quality(docs: DataFrame, labels: DataFrame, loss: float = LOSS) -> DataFrame:
    """Rule statistics and verdict per document of ``docs`` (doc_id, text), with ``labels`` (doc_id, quality 0/1).

    Returns doc_id, the counts, base_failed (fewer than 10 words, or more than
    a fifth of the words in 5-word windows that the text repeats), score and
    kept (false if base_failed or if the score reaches the threshold).

    A null or empty text has no words and fails.  Repeated rows give a row
    each; a document without an id is judged like any other.  Of several labels
    of a document the lowest counts; labels without id or quality count for
    nothing.  Without labels of both kinds only the base rule rejects.  Other
    columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "rules")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = scratch.keep(x.mapInArrow(_stats, _STATS), "stats")
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    labelled = stats.join(marks, "doc_id")
    # ordinary rows carry the trees; the base rule needs no forest
    rows = labelled.where("n_words >= 10").orderBy(F.xxhash64("doc_id", *COUNTS)).limit(SAMPLE_ROWS).select(*COUNTS, "quality").toArrow()
    forest = Forest(features({c: np.asarray(rows[c]).astype(np.int64) for c in COUNTS}), np.asarray(rows["quality"]).astype(np.int64) <= 0)
    scored = scratch.keep(stats.mapInArrow(_scores(spark.sparkContext.broadcast(forest)), _STATS + ", score double"), "scores")
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    bins = (scored.where(~base).join(marks, "doc_id").groupBy(F.floor(F.col("score") * BINS).alias("bin"))
            .agg(F.sum((F.col("quality") > 0).cast("long")).alias("good"), F.sum((F.col("quality") <= 0).cast("long")).alias("bad")).toArrow())
    cut = threshold(*(np.asarray(bins[c]).astype(np.int64) for c in ("bin", "good", "bad")), loss)
    out = scored.withColumn("base_failed", base)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("score") * BINS) < F.lit(cut * BINS)))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", "score")
