"""Exact phrases and near phrases of test items in a corpus, by a distributed positional inverted index.

The index is cut by document: a row holds the postings of a few megabytes of
texts (sorted terms, and for each its positions), so the lists of a phrase meet
in one row and searching needs no shuffle.  A window is looked up from its
rarest term: its positions, less the term's offset, are the places where the
window could start, and the lists of the next rarer terms, each adjusted by its
own offset, cut them down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm import words as W
from threadlake.llm.scratch import Scratch

#: Windows searched by one pass over the index; more are searched in further passes.
PASS_WINDOWS = 100_000

_INDEX = "uids array<long>, doc_ids array<long>, first array<int>, terms array<long>, heads array<int>, postings array<int>"


def text_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of letters, digits and non-ASCII characters (A-Z lower-cased), and each row's first word."""
    buf = W.LOWER[buf]
    s, e, first = W.spans(buf, off, W.ALNUM)
    return W.hashes(buf, s, e), first


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        uid = np.asarray(b.column("uid"))
        for lo, hi, buf, off in W.slices(b.column("text")):
            h, first = text_words(buf, off)
            # a free position after each document keeps phrases from running on into the next one
            pos = np.arange(len(h)) + np.repeat(np.arange(hi - lo), np.diff(first))
            o = np.argsort(h, kind="stable")
            h = h[o]
            heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
            row = [uid[lo:hi], b.column("doc_id").slice(lo, hi - lo), (first + np.arange(hi - lo + 1)).astype(np.int32), h[heads].view(np.int64),
                   np.append(heads, len(h)).astype(np.int32), pos[o].astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x)) for x in row],
                ["uids", "doc_ids", "first", "terms", "heads", "postings"])


def build_index(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(documents, index) tables in the shared folder: uid, doc_id, n_words of each row, and the postings."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("uid", F.monotonically_increasing_id())
    index = scratch.keep(x.select("uid", "doc_id", "text").mapInArrow(_build, _INDEX), "index")
    ends = F.expr("slice(first, 2, size(uids))")
    zipped = F.arrays_zip("uids", "doc_ids", F.expr("slice(first, 1, size(uids))").alias("lo"), ends.alias("hi"))
    rows = index.select(F.explode(zipped).alias("d"))
    return rows.select(F.col("d.uids").alias("uid"), F.col("d.doc_ids").alias("doc_id"), (F.col("d.hi") - F.col("d.lo") - 1).cast("long").alias("n_words")), index


class Windows:
    """Distinct windows of some items: their terms by offset, the items they belong to."""

    def __init__(self, items: list[tuple[str, np.ndarray]], length: int) -> None:
        rows: dict[bytes, int] = {}
        parts: list[np.ndarray] = []
        owner: list[set[str]] = []
        for name, h in items:
            n = len(h)
            for i in range(max(1, n - length + 1) if n else 0):
                w = h[i:i + length]
                k = rows.setdefault(w.tobytes(), len(rows))
                if k == len(parts):
                    parts.append(w)
                    owner.append(set())
                owner[k].add(name)
        self.vocab = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]))
        self.size = np.array([len(w) for w in parts], np.int64)
        self.terms = np.full((len(parts), length), -1, np.int64)
        for k, w in enumerate(parts):
            self.terms[k, :len(w)] = np.searchsorted(self.vocab, w)
        self.names = [sorted(o) for o in owner]
        self.order = np.zeros(self.terms.shape, np.int64)

    def rarest_first(self, count: np.ndarray) -> None:
        """Sort each window's offsets by the number of postings of their terms; free places come last."""
        c = np.where(self.terms >= 0, count[self.terms], np.iinfo(np.int64).max)
        self.order = np.argsort(c, axis=1, kind="stable")


def _lists(row: dict, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per term of vocab its range in the row's postings."""
    terms, heads = row["terms"].view(np.uint64), row["heads"].astype(np.int64)
    if not len(terms):
        return np.zeros(len(vocab), np.int64), np.zeros(len(vocab), np.int64)
    at = np.minimum(np.searchsorted(terms, vocab), len(terms) - 1)
    found = terms[at] == vocab
    return np.where(found, heads[at], 0), np.where(found, heads[at + 1], 0)


def _rows(b: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    for r in range(b.num_rows):
        yield {c: np.asarray(b.column(c)[r].values) for c in b.schema.names}


def _counts(vocab) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocab.value), np.int64)
        for b in batches:
            for row in _rows(b):
                lo, hi = _lists(row, vocab.value)
                total += hi - lo
        m = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(total[m])], ["term", "n"])
    return run


def find(row: dict[str, np.ndarray], w: Windows, slop: int, ranks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, document) of each place where the window's ``ranks`` rarest terms stand within ``slop`` words of their offsets."""
    lo, hi = _lists(row, w.vocab)
    n = hi - lo
    # postings of the wanted terms, sorted by (term, position)
    key = np.repeat(np.arange(len(n)) << 32, n) | row["postings"][np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int64)
    head = np.cumsum(n) - n
    k = np.arange(len(w.terms))
    rare = w.order[:, 0]
    term = w.terms[k, rare]
    many = n[term]
    win = np.repeat(k, many)
    pos = key[np.repeat(head[term] - np.cumsum(many) + many, many) + np.arange(many.sum())] & 0xFFFFFFFF
    first = row["first"].astype(np.int64)
    start, doc = pos - rare[win], np.searchsorted(first, pos, "right") - 1
    for j in range(1, min(ranks, w.terms.shape[1])):
        if not len(win):
            break
        off = w.order[win, j]
        term = w.terms[win, off]
        low = np.maximum(start + off - slop, first[doc])
        high = np.minimum(start + off + slop, first[doc + 1] - 1)
        i = np.searchsorted(key, (term << 32) + low)
        found = np.zeros(len(win), bool)
        inside = (i < len(key)) & (low <= high)
        found[inside] = key[i[inside]] <= (term << 32)[inside] + high[inside]
        m = (term < 0) | found
        win, start, doc = win[m], start[m], doc[m]
    return win, start, doc


def _search(windows, slop: int, ranks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        for b in batches:
            for row in _rows(b.select(["uids", "first", "terms", "heads", "postings"])):
                win, start, doc = find(row, w, slop, ranks)
                if not len(win):
                    continue
                o = np.lexsort((start, doc))
                win, start, doc = win[o], start[o], doc[o]
                cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
                out: list[list] = [[], [], [], []]
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    d = doc[i]
                    out[0].append(int(row["uids"][d]))
                    out[1].append(sorted({x for k in np.unique(win[i:j]).tolist() for x in w.names[k]}))
                    s = start[i:j] - row["first"][d]
                    e = np.minimum(s + w.size[win[i:j]], row["first"][d + 1] - 1 - row["first"][d])
                    s = np.maximum(s, 0)
                    # overlapping places run together
                    top = np.maximum.accumulate(e)
                    head = np.concatenate([[True], s[1:] > top[:-1]])
                    out[2].append(s[head])
                    out[3].append(top[np.append(np.flatnonzero(head)[1:] - 1, len(s) - 1)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.list_(pa.int64())),
                     pa.array(out[3], pa.list_(pa.int64()))], ["uid", "items", "starts", "ends"])
    return run


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of the places and items that the passes found in a document."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            items = sorted({x for p in r["items"] for x in p})
            spans = sorted((s, e) for ps, pe in zip(r["starts"], r["ends"], strict=True) for s, e in zip(ps, pe, strict=True))
            hit, end = 0, 0
            for s, e in spans:
                hit += max(0, e - max(s, end))
                end = max(end, e)
            out.append({"uid": r["uid"], "n_hit": hit, "n_items": len(items), "items": items, "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest()})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("uid", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("items_sha256", pa.string())]))


def _passes(items: DataFrame, length: int) -> Iterator[Windows]:
    """The items' windows in lots of bounded size, read row by row."""
    lot: list[tuple[str, np.ndarray]] = []
    size = 0
    for r in items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").toLocalIterator():
        for _, _, buf, off in W.slices(pa.array([r["text"]], pa.string())):
            h, _ = text_words(buf, off)
            # a very long item is cut in lots of its own, whose windows overlap
            step = PASS_WINDOWS
            for lo in range(0, max(1, len(h) - length + 1), step):
                part = h[lo:lo + step + length - 1]
                if size + len(part) > PASS_WINDOWS and lot:
                    yield Windows(lot, length)
                    lot, size = [], 0
                lot.append((r["item_id"], part))
                size += len(part)
    if lot:
        yield Windows(lot, length)


def contamination(docs: DataFrame, items: DataFrame, length: int = 13, share: int = 20, slop: int = 0, ranks: int | None = None) -> DataFrame:
    """Per document of ``docs`` (doc_id, text) what it repeats of ``items`` (item_id, text).

    Words are runs of letters, digits and non-ASCII characters, A-Z
    lower-cased.  A window is ``length`` consecutive words of an item; an item
    of fewer words is one window.  Returns doc_id, n_words, n_hit (words inside
    any occurrence), n_items, items_sha256 (of the sorted, comma-joined ids),
    contaminated (``n_hit > 0 and share * n_hit >= n_words``) and items.

    With ``slop`` and ``ranks`` it returns proximity matches: the ``ranks``
    rarest terms of a window stand within ``slop`` words of their places.

    A text that is null or has no words has no hits; an item that is null, has
    no id or no words has no windows; repeated items count once, repeated rows
    of ``docs`` give a row each.  Other columns are ignored.  The test set is
    read row by row and searched in passes of PASS_WINDOWS windows, so neither
    the driver nor a broadcast holds more of it than that.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "phrases")
    rows, index = build_index(docs, scratch)
    found = None
    for k, w in enumerate(_passes(items, length)):
        if not len(w.terms):
            continue
        vocab = spark.sparkContext.broadcast(w.vocab)
        count = np.zeros(len(w.vocab), np.int64)
        seen = index.select("terms", "heads").mapInArrow(_counts(vocab), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        count[np.asarray(seen["term"]).astype(np.int64)] = np.asarray(seen["n"]).astype(np.int64)
        w.rarest_first(count)
        hits = index.mapInArrow(_search(spark.sparkContext.broadcast(w), slop, ranks or length), "uid long, items array<string>, starts array<long>, ends array<long>")
        hits = scratch.keep(hits, f"hits-{k}")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], "uid long, items array<string>, starts array<long>, ends array<long>")
    found = found.groupBy("uid").agg(*(F.collect_list(c).alias(c) for c in ("items", "starts", "ends")))
    found = found.mapInArrow(_summary, "uid long, n_hit long, n_items long, items array<string>, items_sha256 string")
    x = rows.join(found, "uid", "left")
    zero = F.lit(0).cast("long")
    out = x.select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((F.coalesce("n_hit", zero) > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    out = Scratch(spark, "contamination").keep(out, "documents")
    scratch.drop()
    return out


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 13, share: int = 20) -> DataFrame:
    """``docs`` without the contaminated ones.  All columns come through.

    Rows are judged by their own texts, which their hashes stand for: rows
    without an id can go, and a row stays if another one of its doc_id goes.
    """
    text = F.col("text").cast("string")
    keyed = docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text"))
    bad = contamination(keyed, items, length, share).where("contaminated").select(F.col("doc_id").alias("key")).distinct().alias("bad")
    return docs.alias("d").join(bad, F.xxhash64(F.col("d.text").cast("string")) == F.col("bad.key"), "left_anti").select("d.*")
