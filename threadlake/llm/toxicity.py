"""Toxicity by a classifier chain.

Categories are predicted one after another.  Each has a linear model on how
often words, and words that begin alike, stand in the text; later models also see the probabilities of the categories
before.  In training these are out-of-fold predictions, so a later model learns
from probabilities as unsure as those it will meet.

The models are trained on a bounded sample of labelled rows (SAMPLE_ROWS); the
words they look at are chosen by a distributed count over that sample.  The
decision threshold is calibrated on all labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm import words as W
from threadlake.llm.scratch import Scratch

#: Labelled rows that models are trained on, words per category, folds.
SAMPLE_ROWS, WORDS, FOLDS = 12_000, 512, 5
#: Bytes of the beginnings of words that count as features beside the whole words.
PREFIXES = (5, 6, 7)
#: A count is divided by 1 + words / DAMPING: in short texts a few hits tell, in long ones the rate does.
DAMPING = 150.0
#: A word must stand in so many documents of the sample to be looked at.
LEAST_DOCS = 5
#: And its share of positive rows must lie so many standard errors from the share of all, beyond what the best of
#: millions of words reaches by chance.
LEAST_Z = 5.0
#: Bins of the probability histogram.
BINS = 1000


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Rows:
    """Sparse rows: for each entry its row, column and value."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int) -> None:
        self.row, self.col, self.val, self.n = row, col, val, n

    @classmethod
    def none(cls, n: int) -> Rows:
        return cls(np.zeros(0, int), np.zeros(0, int), np.zeros(0), n)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col] * self.val, self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row] * self.val, width)


class Linear:
    """Logistic regression on sparse words and a few dense columns (gradient steps with Adam)."""

    def __init__(self, width: int, dense: int) -> None:
        self.w, self.d, self.b = np.zeros(width), np.zeros(dense), 0.0

    def fit(self, x: Rows, z: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = 150, l2: float = 1e-4) -> Linear:
        k = np.concatenate([self.w, self.d, [self.b]])
        m, v = np.zeros_like(k), np.zeros_like(k)
        total, nw = max(use.sum(), 1), len(self.w)
        for t in range(1, steps + 1):
            self.w, self.d, self.b = k[:nw], k[nw:-1], k[-1]
            e = (self.predict(x, z) - y) * use / total
            g = np.concatenate([x.back(e, nw) + l2 * self.w, z.T @ e + l2 * self.d, [e.sum()]])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            k = k - 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w, self.d, self.b = k[:nw], k[nw:-1], float(k[-1])
        return self

    def predict(self, x: Rows, z: np.ndarray) -> np.ndarray:
        return sigmoid(x.times(self.w) + z @ self.d + self.b)


class Chain:
    """Models in the order of the categories, and the hashes of the words that they look at (sorted)."""

    def __init__(self, vocab: np.ndarray, categories: list[str]) -> None:
        self.vocab, self.categories, self.models = vocab, categories, []

    def fit(self, x: Rows, y: np.ndarray, fold: np.ndarray) -> Chain:
        z = np.zeros((x.n, 0))
        for c in range(len(self.categories)):
            out = np.zeros(x.n)
            for f in range(FOLDS):
                held = fold == f
                out[held] = Linear(len(self.vocab), z.shape[1]).fit(x, z, y[:, c], ~held).predict(x, z)[held]
            self.models.append(Linear(len(self.vocab), z.shape[1]).fit(x, z, y[:, c], np.ones(x.n, bool)))
            z = np.column_stack([z, out])
        return self

    def predict(self, x: Rows) -> np.ndarray:
        z = np.zeros((x.n, 0))
        for m in self.models:
            z = np.column_stack([z, m.predict(x, z)])
        return z


def _features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of every word and beginning of a word, and the words of each row; A-Z are lower-cased."""
    buf = W.LOWER[buf]
    s, e, first = W.spans(buf, off, W.ALNUM)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    rows, out = [row], [W.hashes(buf, s, e)]
    for k in PREFIXES:
        m = e - s > k
        rows.append(row[m])
        out.append(W.hashes(buf, s[m], s[m] + k) + np.uint64(k))
    return np.concatenate(rows), np.concatenate(out), n


def _counted(row: np.ndarray, col: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, column) pairs with their damped counts."""
    o = np.lexsort((col, row))
    row, col = row[o], col[o]
    head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (col[1:] != col[:-1])])) if len(row) else np.zeros(0, int)
    many = np.diff(np.append(head, len(row)))
    return row[head], col[head], many / (1 + n[row[head]] / DAMPING)


def _entries(buf: np.ndarray, off: np.ndarray, vocab: np.ndarray) -> Rows:
    """The features of the vocabulary that stand in each row."""
    row, h, n = _features(buf, off)
    if not len(vocab) or not len(h):
        return Rows.none(len(n))
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    m = np.flatnonzero(vocab[at] == h)
    return Rows(*_counted(row[m], at[m], n), len(n))


def _sample_words(ids) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column("doc_id").fill_null(-1)
            m = np.isin(np.asarray(d), ids.value)
            b = b.filter(pa.array(m & ~np.asarray(b.column("doc_id").is_null())))
            for lo, hi, buf, off in W.slices(b.column("text")):
                row, h, val = _counted(*_features(buf, off))
                cut = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64))),
                     pa.ListArray.from_arrays(cut, pa.array(val.astype(np.float32)))], ["doc_id", "words", "vals"])
    return run


def _sample_entries(vocab) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocab.value
        for b in batches:
            cols, vals = [], []
            for x, v in zip(b.column("words"), b.column("vals"), strict=True):
                h = np.asarray(x.values).astype(np.int64).view(np.uint64)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                m = known[at] == h if len(known) and len(h) else np.zeros(len(h), bool)
                cols.append(at[m])
                vals.append(np.asarray(v.values)[m])
            rest = [c for c in b.schema.names if c not in ("words", "vals")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(cols, pa.list_(pa.int64())), pa.array(vals, pa.list_(pa.float32()))], [*rest, "cols", "vals"])
    return run


def train(docs: DataFrame, labels: DataFrame, categories: list[str], scratch: Scratch) -> Chain:
    """Fit a chain; ``labels``: doc_id and one 0/1 column per category, no nulls, one row per document."""
    spark = docs.sparkSession
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    sample = scratch.keep(sample, "sample")
    ids = spark.sparkContext.broadcast(np.asarray(sample.select("doc_id").toArrow()["doc_id"]).astype(np.int64))
    words = docs.select("doc_id", "text").mapInArrow(_sample_words(ids), "doc_id long, words array<long>, vals array<float>")
    # of different texts of one document the same one in each run
    words = words.groupBy("doc_id").agg(F.min(F.struct("words", "vals")).alias("first")).select("doc_id", "first.*").join(sample, "doc_id")
    words = scratch.keep(words, "words")
    y_sum = [F.sum(c).alias(c) for c in categories]
    total = words.agg(F.count(F.lit(1)).alias("n"), *y_sum).collect()[0]
    if not total["n"]:
        return Chain(np.zeros(0, np.uint64), categories).fit(Rows.none(0), np.zeros((0, len(categories))), np.zeros(0, int))
    count = words.select(F.explode("words").alias("word"), *categories).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *y_sum).where(F.col("n") >= LEAST_DOCS)
    count = scratch.keep(count, "count")
    vocab: set[int] = set()
    for c in categories:
        # distance of the word's share of positive rows from the share of all, in standard errors
        p = total[c] / total["n"]
        z = F.abs(F.col(c) - F.col("n") * p) / F.sqrt(F.col("n") * max(p * (1 - p), 1e-6))
        vocab |= {r["word"] for r in count.where(z >= LEAST_Z).orderBy(F.desc(z), "word").limit(WORDS).select("word").collect()}
    known = np.unique(np.array(sorted(vocab), np.int64).view(np.uint64))
    schema = "doc_id long, " + ", ".join(f"{c} int" for c in categories) + ", cols array<long>, vals array<float>"
    rows = words.select("doc_id", *categories, "words", "vals").mapInArrow(_sample_entries(spark.sparkContext.broadcast(known)), schema).orderBy("doc_id").toArrow()
    cols = [np.asarray(x.values).astype(np.int64) for x in rows["cols"].combine_chunks()]
    vals = [np.asarray(x.values).astype(float) for x in rows["vals"].combine_chunks()]
    x = Rows(np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate([*cols, np.zeros(0, np.int64)]), np.concatenate([*vals, np.zeros(0)]), len(cols))
    y = np.column_stack([np.asarray(rows[c]).astype(float) for c in categories])
    fold = (W.mix(np.asarray(rows["doc_id"]).astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(int)
    return Chain(known, categories).fit(x, y, fold)


def _score(chain) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = chain.value
        for b in batches:
            for lo, hi, buf, off in W.slices(b.column("text")):
                p = c.predict(_entries(buf, off, c.vocab))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), *(pa.array(p[:, k]) for k in range(p.shape[1]))], ["doc_id", *(f"p_{x}" for x in c.categories)])
    return run


def last_probability(chain) -> Callable[[Column], Column]:
    """A column function: the probability of the chain's last category for a text (Arrow batches)."""

    @F.arrow_udf("double")
    def p(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = chain.value
        for x in text:
            out = [c.predict(_entries(buf, off, c.vocab))[:, -1] for _, _, buf, off in W.slices(x)]
            yield pa.array(np.concatenate([*out, np.zeros(0)]))
    return p


def best_cut(bins: np.ndarray, clean: np.ndarray, bad: np.ndarray) -> float:
    """The probability from which documents are rejected, with the fewest wrong labelled rows (the middle of equal ones)."""
    c, b = np.zeros(BINS + 2), np.zeros(BINS + 2)
    c[bins], b[bins] = clean, bad
    wrong = np.concatenate([[0], np.cumsum(b)])[:-1] + c.sum() - np.concatenate([[0], np.cumsum(c)])[:-1]
    best = np.flatnonzero(wrong == wrong.min())
    return float(best[len(best) // 2]) / BINS


CATEGORIES = ["low_quality", "toxic"]


def categories(labels: DataFrame) -> DataFrame:
    """The chain's categories from ``labels`` (doc_id, quality, toxic): one row per document, unknown ones left out."""
    x = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") <= 0).cast("int").alias("low_quality"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    return x.dropna().groupBy("doc_id").agg(F.max("low_quality").alias("low_quality"), F.max("toxic").alias("toxic"))


class Detector:
    """A trained chain with its calibrated threshold and the scores of the documents it was calibrated on."""

    def __init__(self, docs: DataFrame, labels: DataFrame, scratch: Scratch) -> None:
        spark = docs.sparkSession
        x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        marks = categories(labels)
        self.chain = spark.sparkContext.broadcast(train(x, marks, CATEGORIES, scratch))
        schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES)
        self.scores = scratch.keep(x.mapInArrow(_score(self.chain), schema), "scores")
        last = CATEGORIES[-1]
        bins = (self.scores.join(marks, "doc_id").groupBy(F.floor(F.col(f"p_{last}") * BINS).cast("long").alias("bin"))
                .agg(F.sum(1 - F.col(last)).alias("clean"), F.sum(last).alias("bad")).toArrow())
        cols = [np.asarray(bins[c]).astype(np.int64) for c in ("bin", "clean", "bad")]
        self.cut = best_cut(*cols) if cols[1].sum() and cols[2].sum() else 2.0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document of ``docs`` (doc_id, text) the chain's probabilities and verdict, with ``labels`` (doc_id, quality, toxic).

    Returns doc_id, p_low_quality, p_toxic and toxic (p_toxic reaches the
    calibrated threshold).  A null or empty text has no words and gets the
    models' base probability.  Labels without an id or with a null category
    count for nothing; of several labels of a document the worst counts.
    Without labels of both kinds nothing is rejected.  Of
    different texts of a labelled doc_id one trains, the same in each run, and
    all are calibrated on.  Repeated rows give a row
    each; documents without an id are scored too.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    d = Detector(docs, labels, scratch)
    return d.scores.withColumn("toxic", F.floor(F.col("p_toxic") * BINS) >= F.lit(d.cut * BINS))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the chain rejects; rows are judged by their own text, all columns come through."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    d = Detector(docs, labels, scratch)
    scratch.drop()
    p = last_probability(d.chain)(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.where(F.floor(p * BINS) < F.lit(d.cut * BINS))
