"""N-gram Jaccard self-join by vertical partitioning.

All n-grams have one global order: those found often come last, by their
document frequency, the others first, by hash.  A set that shares at least the
threshold with another shares one of its first ``n - ceil(t * n) + 1`` n-grams
in that order (its prefix), whatever the order is.  So the order decides only
the cost, never the result.

Candidates are found on prefixes, pruned by length and by parity bitmaps (both
bounds are exact), and verified by vertical partitioning: the hash range is cut
into fragments, the overlap of a pair is counted in each fragment on its own
and summed per pair.

Copies of one set are one class from the start.  Within a posting list a class
offers only its nearest partner (by bitmap), so a group of m near copies gives
m candidates, not m * m; once these links are merged, the pairs that remain
between different components are enumerated completely, so no link is lost.
Posting lists longer than a block are cut in blocks, and pairs of blocks are
dealt to tasks on their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.llm import words as W
from threadlake.llm.components import components
from threadlake.llm.scratch import Scratch

#: N-grams kept as "found often" for the global order (16 bytes each, broadcast).
ORDER_GRAMS = 1 << 16
#: An n-gram is offered as frequent by a slice of texts in which so many documents have it.
FREQUENT = 3
#: Fewest and most bits of a set's bitmap; between them it has one to two bits for each n-gram.
LEAST_BITS, MOST_BITS = 256, 1 << 14
#: Bytes of the folded bitmap that goes into the blocks of long posting lists with every member.
BLOCK_BYTES = 128
#: Posting lists up to this length emit their pairs at once.
SHORT_LIST = 8
#: Members of one block of a longer posting list.
BLOCK = 4096
#: Bits of the filter that says whose texts are read again; more candidates than fit only make it pass more texts.
FILTER_BITS = 1 << 23
#: Fragments of the hash range.
FRAGMENTS = 4
#: Set signatures a task remembers to emit a copied set once.
SEEN = 1 << 18

_PCT = 100


def need(n: np.ndarray, pct: int) -> np.ndarray:
    """Smallest overlap that a set of n can have with any partner: ceil(pct * n / 100)."""
    return -(-pct * n // _PCT)


def gram_sets(buf: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct k-gram hashes of each row; a shorter row is one gram, an empty one none."""
    buf = W.LOWER[buf]
    s, e, first = W.spans(buf, off, W.NON_SPACE)
    h = W.hashes(buf, s, e)
    for i in range(len(off) - 1):
        x = h[first[i]:first[i + 1]]
        yield np.unique(W.windows(x, k) if len(x) >= k else W.sequence_hash(x))


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def class_id(sig: bytes) -> int:
    """63 bits of a signature: the id of the class of equal sets, known without a shuffle (two sets collide as seldom as two n-grams)."""
    return int.from_bytes(sig[:8], "little") >> 1


def parity(s: np.ndarray) -> bytes:
    """Parity bitmap: bit i is the parity of the grams whose hash ends in i.

    Two sets' bitmaps differ in at most as many bits as the sets have grams not
    in common.  The halves of a bitmap, xor-ed, are the bitmap of half the size.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(s) - 1).bit_length()))
    k = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(k.astype(np.uint8), bitorder="little").tobytes()


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (last axis: 64-bit words) folded to size words."""
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def small_bitmap(bits: bytes) -> bytes | None:
    """The bitmap folded to BLOCK_BYTES; None if it is not larger."""
    return _fold(np.frombuffer(bits, np.uint64), BLOCK_BYTES // 8).tobytes() if len(bits) > BLOCK_BYTES else None


def _frequent(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, off in W.slices(b.column(0)):
                sets = list(gram_sets(buf, off, k))
                g, c = np.unique(np.concatenate(sets), return_counts=True)
                m = c >= FREQUENT
                if m.any():
                    yield pa.RecordBatch.from_arrays([pa.array(g[m].view(np.int64)), pa.array(c[m])], ["gram", "docs"])
    return run


def global_order(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent n-grams (sorted hashes) and their document counts, at most ORDER_GRAMS."""
    rows = (docs.select("text").mapInArrow(_frequent(k), "gram long, docs long").groupBy("gram")
            .agg(F.sum("docs").alias("docs")).orderBy(F.desc("docs"), "gram").limit(ORDER_GRAMS).toArrow())
    g = np.asarray(rows["gram"]).astype(np.int64).view(np.uint64)
    c = np.asarray(rows["docs"]).astype(np.int64)
    o = np.argsort(g)
    return g[o], c[o]


def _describe(k: int, pct: int, order) -> Callable:
    """Per document: set size and class (null without words); once per class and task also bitmaps and the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, count = order.value
        seen: set[bytes] = set()
        for b in batches:
            for lo, hi, buf, off in W.slices(b.column("text")):
                out: dict[str, list] = {c: [] for c in ("n", "cls", "bits", "small", "prefix")}
                for s in gram_sets(buf, off, k):
                    n, sig = len(s), signature(s)
                    new = n and sig not in seen
                    out["n"].append(n)
                    out["cls"].append(class_id(sig) if n else None)
                    if not new:
                        out["bits"].append(None)
                        out["small"].append(None)
                        out["prefix"].append(None)
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(sig)
                    out["bits"].append(parity(s))
                    out["small"].append(small_bitmap(out["bits"][-1]))
                    p = n - int(need(np.int64(n), pct)) + 1
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        late = often[at] == s
                        rare = s[~late]
                        if len(rare) < p:
                            tail = s[late]
                            rare = np.concatenate([rare, tail[np.lexsort((tail, count[at[late]]))]])
                        out["prefix"].append(rare[:p].view(np.int64))
                    else:
                        out["prefix"].append(s[:p].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("th").slice(lo, hi - lo), pa.array(out["n"], pa.int64()),
                     pa.array(out["cls"], pa.int64()), pa.array(out["bits"], pa.binary()),
                     pa.array(out["small"], pa.binary()), pa.array(out["prefix"], pa.list_(pa.int64()))],
                    ["doc_id", "th", "n", "cls", "bits", "small", "prefix"])
    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by keys; a group spans batches only until it ends."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for c in keys:
            x = np.asarray(b.column(c))
            change[1:] |= x[1:] != x[:-1]
        if rest and any(rest[-1].column(c)[-1].as_py() != b.column(c)[0].as_py() for c in keys):
            yield pa.Table.from_batches(rest)
            rest = []
        cut = np.flatnonzero(change)
        if not len(cut):
            rest.append(b)
            continue
        yield pa.Table.from_batches([*rest, b.slice(0, cut[0])])
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            yield pa.Table.from_batches([b.slice(i, j - i)])
        rest = [b.slice(cut[-1])]
    if rest:
        yield pa.Table.from_batches(rest)


def _short_pairs(pct: int) -> Callable:
    """Pairs of the short posting lists: rows come sorted by gram, with sizes near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            g, c, n = (np.asarray(b.column(x)) for x in ("gram", "cls", "n"))
            if tail is not None:
                g, c, n = (np.concatenate([t, x]) for t, x in zip(tail, (g, c, n), strict=True))
            a, z = [], []
            for d in range(1, SHORT_LIST):
                if len(g) <= d:
                    break
                m = (g[d:] == g[:-d]) & (_PCT * np.minimum(n[d:], n[:-d]) >= pct * np.maximum(n[d:], n[:-d])) & (c[d:] != c[:-d])
                # a pair within the rows held over was sent with its batch
                if tail is not None:
                    m &= np.arange(d, len(g)) >= len(tail[0])
                a.append(np.minimum(c[d:], c[:-d])[m])
                z.append(np.maximum(c[d:], c[:-d])[m])
            k = min(len(g), SHORT_LIST - 1)
            tail = [x[len(x) - k:].copy() for x in (g, c, n)]
            if a:
                pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(z)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
    return run


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of every row of x with every row of y."""
    out = np.zeros((len(x), len(y)), np.int64)
    for w in range(x.shape[1]):
        out += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    return out


def _block_pairs(pct: int, every: bool) -> Callable:
    """Pairs of the blocks of long posting lists that the bounds let pass.

    ``every`` false: each member's nearest smaller partner.  ``every`` true:
    all pairs of different components, but for those that share the list
    before this one, or the one before that, in the order of the grams: they
    were compared there.  So a pair of many common grams is sent once or a few times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for t in _groups(batches, ["gram", "i", "j"]):
            t = t.combine_chunks()
            cls, n, comp, blk = (np.asarray(t[x]) for x in ("cls", "n", "comp", "blk"))
            i, j = t["i"][0].as_py(), t["j"][0].as_py()
            if every and (comp == comp[0]).all():
                continue
            o = np.lexsort((cls, n))
            cls, n, comp, blk = cls[o], n[o], comp[o], blk[o]
            last = [[np.asarray(t[f"p{k}"].fill_null(0))[o], np.asarray(t[f"p{k}"].is_valid())[o]] for k in (1, 2)] if every else []
            bits = t["bits"].to_pylist()
            bm = [np.frombuffer(bits[x], np.uint64) for x in o]
            size, folded, start = 0, None, 0
            end = np.searchsorted(n, _PCT * n // pct, "right")
            best = np.full(len(cls), 1 << 40)
            at = np.full(len(cls), -1)
            length = np.array([len(x) for x in bm])
            lo = 0
            while lo < len(cls):
                # rows come by set size, so later bitmaps are as large or larger: a strip's rows have equal ones
                hi = min(lo + 64, int(np.searchsorted(length, length[lo], "right")))
                top = int(end[hi - 1])
                if len(bm[lo]) != size:
                    size, start = len(bm[lo]), lo
                    folded = np.stack([_fold(x, size) for x in bm[lo:]])
                x = _far(folded[lo - start:hi - start], folded[lo - start:top - start])
                r, q = np.arange(lo, hi)[:, None], np.arange(lo, top)[None, :]
                # |A xor B| <= (100 - pct) / (100 + pct) * (|A| + |B|)
                ok = (q > r) & ((_PCT + pct) * x <= (_PCT - pct) * (n[lo:hi, None] + n[None, lo:top])) & (q < end[lo:hi, None])
                if i != j:
                    ok &= blk[lo:hi, None] != blk[None, lo:top]
                if every:
                    u, v = np.nonzero(ok & (comp[lo:hi, None] != comp[None, lo:top]))
                    u, v = u + lo, v + lo
                    met = np.zeros(len(u), bool)
                    for g, known in last:
                        for h, there in last:
                            met |= known[u] & there[v] & (g[u] == h[v])
                    u, v = cls[u[~met]], cls[v[~met]]
                    new = [(a, b) for a, b in zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), strict=True)
                           if (a, b) not in sent]
                    if len(sent) > SEEN:
                        sent.clear()
                    sent.update(new)
                    if new:
                        new = list(dict.fromkeys(new))
                        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], ["a", "b"])
                else:
                    x = np.where(ok, x, 1 << 40)
                    k = x.argmin(0)
                    d = x[k, np.arange(top - lo)]
                    m = d < best[lo:top]
                    best[lo:top][m] = d[m]
                    at[lo:top][m] = k[m] + lo
                lo = hi
            if not every:
                m = np.flatnonzero(at >= 0)
                u, v = cls[m], cls[at[m]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["a", "b"])
    return run


def _bitmap_filter(pct: int) -> Callable:
    """Drop pairs whose bitmaps differ in too many bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            na, nb = np.asarray(b.column("na")), np.asarray(b.column("nb"))
            for r, (x, y) in enumerate(zip(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                size = min(len(x), len(y))
                far = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
                keep[r] = (_PCT + pct) * far <= (_PCT - pct) * int(na[r] + nb[r])
            t = b.select(["a", "b", "na", "nb", "th_a", "th_b"])
            yield t.filter(pa.array(keep))
    return run


_PAIR = "a long, b long, na long, nb long, th_a long, th_b long"


def _bits(th: Column) -> list[Column]:
    return [F.pmod(th, F.lit(FILTER_BITS)), F.pmod(F.shiftright(th, 31), F.lit(FILTER_BITS))]


def _wanted(pairs: DataFrame) -> np.ndarray:
    """The filter of the text hashes that verification needs (FILTER_BITS bits, whatever the input)."""
    bit = pairs.select(F.explode(F.array("th_a", "th_b")).alias("th")).select(F.explode(F.array(*_bits(F.col("th")))).alias("bit"))
    rows = bit.groupBy(F.expr("bit div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("x")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[np.asarray(rows["w"]).astype(np.int64)] = np.asarray(rows["x"]).astype(np.int64)
    return out.view(np.uint64)


def _fragments(k: int, wanted) -> Callable:
    """The sets of the wanted texts, cut into fragments of the hash range."""
    shift = np.uint64(64 - FRAGMENTS.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        seen: set[bytes] = set()

        def has(x: np.ndarray) -> np.ndarray:
            return bits[x // 64] >> (x % 64).astype(np.uint64) & np.uint64(1) != 0

        for b in batches:
            th = np.asarray(b.column("th"))
            b = b.filter(pa.array(has(th % FILTER_BITS) & has((th >> 31) % FILTER_BITS)))
            for _, _, buf, off in W.slices(b.column("text")):
                cls, frag, part = [], [], []
                for s in gram_sets(buf, off, k):
                    x = signature(s)
                    if not len(s) or x in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(x)
                    for f, p in enumerate(np.split(s, np.searchsorted(s >> shift, np.arange(1, FRAGMENTS, dtype=np.uint64)))):
                        if len(p):
                            cls.append(class_id(x))
                            frag.append(f)
                            part.append(p.view(np.int64))
                if cls:
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(frag, pa.int32()), pa.array(part, pa.list_(pa.int64()))], ["cls", "frag", "grams"])
    return run


def _verify(spark: SparkSession, texts: DataFrame, pairs: DataFrame, k: int, pct: int) -> DataFrame:
    """Links (a, b) among the pairs: overlaps counted fragment by fragment, summed per pair."""
    wanted = spark.sparkContext.broadcast(_wanted(pairs))
    sets = (texts.select("th", "text").mapInArrow(_fragments(k, wanted), "cls long, frag int, grams array<long>")
            .groupBy("cls", "frag").agg(F.first("grams").alias("grams")))
    # a pair goes to each fragment, so the sets stay where they were gathered
    left = pairs.select("a", "b", "na", "nb", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("frag"))
    left = left.join(sets.select(F.col("cls").alias("a"), "frag", F.col("grams").alias("ga")), ["a", "frag"])
    both = left.join(sets.select(F.col("cls").alias("b"), "frag", F.col("grams").alias("gb")), ["b", "frag"])
    part = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("common"))
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return total.where(F.col("common") * _PCT >= (F.col("na") + F.col("nb") - F.col("common")) * pct).select("a", "b", "na", "nb", "common")


def jaccard_join(docs: DataFrame, k: int = 5, pct: int = 75) -> tuple[DataFrame, DataFrame, Scratch]:
    """Near-duplicate classes and links of ``docs`` (doc_id long, text string; other columns are ignored).

    Returns (members, links, scratch).  ``members`` has one row per document:
    doc_id, n_shingles (size of its set of distinct k-word shingles; A-Z are
    lower-cased, words end at ASCII white space, a text of fewer words is one
    shingle), class_id (documents with equal sets share one; -1 without words)
    and component_id (the smallest doc_id that links reach, itself included).
    ``links`` has verified pairs of class ids with sizes and overlap; together
    they connect whatever is connected, and copies are not expanded.

    Two documents link when ``100 * |A and B| >= pct * |A or B|``.  Null and
    blank texts have an empty set, link with nothing and are their own
    component.  A document without an id takes part in links; its component_id
    is the smallest id in its component, null if there is none.  Repeated rows
    give a row each.  An empty table gives empty results.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text")).alias("th"))
    order = spark.sparkContext.broadcast(global_order(texts, k))
    seen = texts.mapInArrow(_describe(k, pct, order), "doc_id long, th long, n long, cls long, bits binary, small binary, prefix array<long>")
    seen = scratch.keep(seen, "documents")
    one = F.min(F.struct("n", "th", "bits", "small")).alias("r")
    classes = scratch.keep(seen.where("bits is not null").groupBy("cls").agg(one).select("cls", "r.n", "r.th", "r.bits", "r.small"), "classes")

    by_gram = Window.partitionBy("gram")
    # copies met by different tasks fall together in the groups, where the window has them already
    lists = (seen.where("prefix is not null").select(F.explode("prefix").alias("gram"), "cls", "n")
             .withColumn("len", F.count(F.lit(1)).over(by_gram)).where("len > 1").groupBy("gram", "cls").agg(F.first("n").alias("n"))
             .withColumn("len", F.count(F.lit(1)).over(by_gram)).where("len > 1"))
    lists = scratch.keep(lists, "lists")

    short = (lists.where(F.col("len") <= SHORT_LIST).repartition("gram").sortWithinPartitions("gram", "cls").select("gram", "cls", "n")
             .mapInArrow(_short_pairs(pct), "a long, b long"))

    def long_lists(label: DataFrame | None, every: bool) -> DataFrame:
        x = lists.where(F.col("len") > SHORT_LIST)
        if label is None:
            x = x.withColumn("comp", F.col("cls"))
        else:
            x = x.join(label, x.cls == label.node, "left").withColumn("comp", F.coalesce("component", "cls")).drop("node", "component")
        if every:
            x = x.withColumn("lo", F.min("comp").over(by_gram)).withColumn("hi", F.max("comp").over(by_gram)).where("lo < hi").drop("lo", "hi")
        x = x.join(classes.select("cls", F.coalesce("small", "bits").alias("bits")), "cls")
        last = []
        if every:  # the class's lists before this one, on the join's partitioning
            own = Window.partitionBy("cls").orderBy("gram")
            last = ["p1", "p2"]
            x = x.withColumn("p1", F.lag("gram", 1).over(own)).withColumn("p2", F.lag("gram", 2).over(own))
        blocks = F.expr(f"cast(ceil(len / {BLOCK}) as int)")
        x = x.withColumn("blk", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        x = x.select("gram", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "cls", "n", "comp", "blk", "bits", *last)
        return x.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j").mapInArrow(_block_pairs(pct, every), "a long, b long")

    def near_enough(pairs: DataFrame, name: str) -> DataFrame:
        side = lambda s: classes.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("th").alias(f"th_{s}"), F.col("bits").alias(f"bits_{s}"))
        x = pairs.distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(_bitmap_filter(pct), _PAIR)
        return scratch.keep(x, name)

    first = near_enough(short.unionByName(long_lists(None, False)), "pairs-1")
    links = scratch.keep(_verify(spark, texts, first, k, pct), "links-1")
    label = components(links, scratch, "near")
    second = near_enough(long_lists(label, True).join(links.select("a", "b"), ["a", "b"], "left_anti"), "pairs-2")
    more = scratch.keep(_verify(spark, texts, second, k, pct), "links-2")
    links = links.unionByName(more)
    # the labels stand for the links they were made of, and are stars already
    stars = label.select(F.col("node").alias("a"), F.col("component").alias("b"))
    label = scratch.keep(components(stars.unionByName(more.select("a", "b")), scratch, "all"), "labels")

    x = seen.select("doc_id", "n", "cls")
    x = x.join(label, x.cls == label.node, "left").select("doc_id", "n", "cls", F.coalesce("component", "cls").alias("comp"))
    least = x.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = x.join(least, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("cls", F.lit(-1)).alias("class_id"),
        F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    return out, links, scratch


def near_groups(docs: DataFrame, k: int = 5, pct: int = 75) -> DataFrame:
    """``members`` of :func:`jaccard_join`, written to the shared folder; its other tables are removed."""
    members, _, scratch = jaccard_join(docs, k, pct)
    kept = Scratch(docs.sparkSession, "near-groups").keep(members, "members")
    scratch.drop()
    return kept


def one_per_group(docs: DataFrame, k: int = 5, pct: int = 75) -> DataFrame:
    """``docs`` with one document of each group of linked ones: that with the smallest doc_id.

    Rows are judged by their own texts, which their hashes stand for.  Rows
    without words stand alone and stay.  A row without an id stays only if its
    group has no id at all (ties: the smallest hash of the text), and of
    repeated rows with the same id and text one stays.  All columns of ``docs``
    come through, whatever their names.
    """
    key = lambda side: F.xxhash64(F.col(f"{side}text").cast("string"))
    m = near_groups(docs.select(key("").alias("doc_id"), "text"), k, pct).where("n_shingles > 0")
    m = m.groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("comp"))
    pairs = docs.groupBy(F.col("doc_id").alias("id"), key("").alias("key")).agg(F.count(F.lit(1)).alias("rows")).join(m, "key")
    first = F.struct(F.col("id").isNull(), "id", "key")
    lead = pairs.groupBy("comp").agg(F.min_by(F.struct("id", "key", "rows"), first).alias("l")).select("l.*").alias("l")
    fresh = "_key"
    while fresh in docs.columns:
        fresh += "_"
    both = docs.alias("d").join(lead, (key("d.") == F.col("l.key")) & F.col("d.doc_id").eqNullSafe(F.col("l.id")))
    single = both.where("l.rows = 1").select("d.*")
    repeated = both.where("l.rows > 1").select("d.*", F.col("l.key").alias(fresh)).dropDuplicates(["doc_id", fresh]).drop(fresh)
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return single.unionByName(repeated).unionByName(docs.where(~worded))
