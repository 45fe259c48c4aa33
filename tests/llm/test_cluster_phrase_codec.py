"""Centroid clustering, collocations and the BPE codec against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from threadlake.llm import collocations, pivots, queries, triebpe

# ------------------------------------------------------------------------------------------------ clustering

VECTORS = "vec_id long, embedding array<float>, cluster int, v string, codes string, to_pivots int"


def plain_clusters(rows, k=16, rounds=3):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in e]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in first[:k]]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in kept]
        if step < rounds:
            for j in range(len(cents)):
                mine = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
                if mine:
                    cents[j] = [math.floor(Fraction(sum(col), len(mine))) for col in zip(*mine, strict=True)]
    own = Counter()
    for d, j in near if kept else []:
        own[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, j, d, own[j], sum(own.values()), digest[j]) for (i, _), (d, j) in zip(kept, near if kept else [], strict=True)]


def clustered(spark, rows):
    df = spark.createDataFrame([(i, e, 1, "v", "c", 2) for i, e in rows], VECTORS)
    out = pivots.cluster(df)
    got = [tuple(r)[:6] for r in out.collect()]
    assert sorted(got, key=repr) == sorted(plain_clusters(rows), key=repr)
    return out


def vectors(rng, n, groups):
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(groups)]
    return [[float(np.float32(x + rng.gauss(0, 0.05))) for x in rng.choice(centres)] for _ in range(n)]


def test_clusters_equal_the_plain_version(spark):
    rng = random.Random(3)
    good = [(i, e) for i, e in enumerate(vectors(rng, 400, 12))]
    odd = [(500, None), (501, []), (502, [0.5] * 63), (503, [0.5] * 65), (504, [math.nan] + [0.0] * 63), (505, [math.inf] + [0.0] * 63), (506, [None] + [0.0] * 63),
           (507, [0.0] * 64), (508, [-0.0] * 64), (None, [0.1] * 64), (None, [0.1] * 64), good[3], good[3], (good[4][0], good[5][1]), (509, [-1e5] * 64)]
    out = clustered(spark, good + odd)
    made = out.groupBy().sum("n_exact").collect()[0][0]
    assert made < 0.5 * 16 * out.count()  # the table rules out most centroids


def test_clusters_of_ties_few_vectors_and_none(spark):
    clustered(spark, [(i, [float(i % 2)] * 64) for i in range(40)])  # equal centroids: the smaller number takes all
    clustered(spark, [(i, [i / 7.0] * 64) for i in range(5)])
    clustered(spark, [(1, None)])
    clustered(spark, [])


def test_vectors_too_large_for_a_long_distance_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        pivots.cluster(spark.createDataFrame([(1, [1e9] * 64, 1, "v", "c", 2)], VECTORS)).collect()


@pytest.mark.parametrize("seed", range(5))
def test_bounds_never_lose_the_nearest(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-40, 40, (300, 8)) if seed else rng.integers(-(1 << 26), 1 << 26, (300, 8))
    cents = np.vstack([x[:10], x[:2]])
    piv = pivots.farthest_first(x, 4)
    near, best, _ = pivots.nearest(x, pivots.distances(x, piv), cents, piv)
    d = ((x[:, None] - cents[None]) ** 2).sum(2)
    assert (near == d.argmin(1)).all() and (best == d.min(1)).all()


# ---------------------------------------------------------------------------------------------- collocations

TEXTS = "doc_id long, lang string, text string, n int, phrase string, word_id long, rank int, shard long, w1 string"


def plain_collocations(rows, max_words=3, min_count=10, top=2000):
    f = defaultdict(Counter)
    n = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        scored = []
        for p, a in cand.items():
            if any(100 * b >= 50 * a for q, b in cand.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            s, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(i, lang, t, 1, "p", 2, 3, 4, "w") for i, (lang, t) in enumerate(rows)], TEXTS).repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, **how).collect())
    assert got == plain_collocations(rows, **how)
    return got


@pytest.fixture(scope="module")
def chatter():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)] + ["New", "York", "CITY", "é", "É", "\U0001f600", "\x0b", "a.b", "\x00", "­"]
    fixed = ["New York city", "of the", "x y", "x x x x", "ab\tcd", "in spite of"]
    out = []
    for _ in range(400):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(40))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n"]) for p in parts)
        out.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return out + [("en", None), (None, ""), ("xx", None), ("yy", " \n\t."), ("zz", "one two"), out[0], out[0], ("en", "lo ng " * 30_000)]


def test_collocations_equal_the_plain_version(spark, chatter):
    got = mined(spark, chatter)
    assert len({lang for lang, *_ in got}) >= 4 and any(p.count(" ") == 2 for _, _, p, *_ in got)


@pytest.mark.parametrize("how", [{"max_words": 2, "top": 7}, {"max_words": 5, "min_count": 6, "top": 50}, {"max_words": 4, "min_count": 1, "top": 30}])
def test_collocations_of_other_lengths(spark, chatter, how):
    mined(spark, chatter[:120], **how)


def test_small_shards_give_the_same(spark, chatter, monkeypatch):
    want = mined(spark, chatter)
    monkeypatch.setattr(collocations, "SHARD_BYTES", 300)  # in the driver only; the shards below are cut here
    docs = [t.encode() for lang, t in chatter if lang == "en" and t]
    total = Counter()
    for lo in range(0, len(docs), 7):
        known = {b"": 0, b"\n": 1}
        ids = collocations._cut(docs[lo:lo + 7], known)
        words = [None, *list(known)[2:]]
        index = collocations.Index.build(ids, 2)
        found = collocations.enumerate_phrases(index, 3)
        for p, size in zip(found.phrases.tolist(), found.size.tolist(), strict=True):
            total[b" ".join(words[i] for i in p).decode()] += size
    assert all(total[p] == a for lang, _, p, a, *_ in want if lang == "en" and p.count(" ") == 2)


def test_no_texts_no_phrases(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", None), (None, "")]) == []


@pytest.mark.parametrize("first", [True, False])
def test_index_extends_to_both_sides(first):
    rng = np.random.default_rng(4)
    seq = np.r_[0, rng.integers(0, 6, 500), 0].astype(np.int32)
    index = collocations.Index.build(seq, 3)
    found = index.extend(index.words(), first)
    for left in (not first, first):
        found = index.extend(found, left)
        k = found.phrases.shape[1]
        want = Counter(tuple(w) for i in range(len(seq) - k + 1) if 0 not in (w := seq[i:i + k].tolist()))
        assert Counter(dict(zip(map(tuple, found.phrases.tolist()), found.size.tolist(), strict=True))) == want


# ------------------------------------------------------------------------------------------------- BPE codec

@pytest.fixture(scope="module")
def codec():
    return triebpe.Codec(queries.vocabulary())


def odd_texts():
    rng = random.Random(1)
    alphabet = "aaabbeeettthhinnoos'’s.,!<|>é̈ÀÉİΣσßſ中文字\U0001f600\U0001f3fd‍ \t\r\n 0123 ٣½²ǅ한국가\x00\x85 "
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    return out + ["", " ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "a" * 5000, "ab" * 3000, "the" * 2000, "é" * 300, "!" * 700,
                  "can't won't 'S 'LL i'm rock'n'roll", "</w> a</w>", "ΑΣ ΑΣ. ΣΑΣ", "x" * 64, "x" * 65]


def test_codec_equals_the_library(codec):
    texts = odd_texts()
    for t, ids, want in zip(texts, codec.encode(texts), codec.vocab.tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, t
        assert codec.decode(ids).decode() == codec.vocab.tok.decode(want.ids, skip_special_tokens=False), t


def test_trie_bounds_change_nothing(monkeypatch):
    monkeypatch.setattr(triebpe, "MAX_NODES", 50)
    monkeypatch.setattr(triebpe, "MEMO_BYTES", 1000)
    monkeypatch.setattr(triebpe, "MAX_BORDERS", 20)
    monkeypatch.setattr(triebpe, "KEPT_CHARS", 6)
    test_codec_equals_the_library(triebpe.Codec(queries.vocabulary()))


def test_other_vocabularies():
    other = triebpe.Codec(queries.vocabulary("byte_bpe_50k.json"))  # pieces keep their blanks, decoder of bytes
    texts = odd_texts()[:800] + ["Hello  world, it's <|endoftext|> 2024", "é" * 200]
    for t, ids, want in zip(texts, other.encode(texts), other.vocab.tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, t
        assert other.decode(ids).decode() == other.vocab.tok.decode(want.ids, skip_special_tokens=False), t


def test_codec_on_tables(spark, codec):
    rows = [(i, t) for i, t in enumerate(odd_texts()[:200])] + [(900, None), (None, "no id"), (901, "twice twice"), (901, "twice twice"), (902, "long " * 100_000)]
    docs = spark.createDataFrame([(d, t, "x", 1, b"y") for d, t in rows], "doc_id long, text string, lang string, n_tokens int, ids binary").repartition(3)
    coded = triebpe.encode(docs, queries.vocabulary())
    want = []
    for d, t in rows:
        ids = codec.vocab.tok.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), np.array(ids, "<u4").tobytes(), codec.vocab.tok.decode(ids, skip_special_tokens=False)))
    assert sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in coded.collect()), key=repr) == sorted((w[:3] for w in want), key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in triebpe.decode(coded, queries.vocabulary()).collect()), key=repr) == sorted(((w[0], w[3]) for w in want), key=repr)
    digests = [(d, n, hashlib.sha256(x).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, n, x, t in want]
    assert sorted(map(tuple, triebpe.digests(docs, queries.vocabulary()).collect()), key=repr) == sorted(digests, key=repr)
    assert triebpe.digests(docs.limit(0), queries.vocabulary()).collect() == []
