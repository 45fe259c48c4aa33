"""Secret scan: patterns with spans, and a randomness test battery, in DataFrame functions only.

Patterns give the base spans.  Beside them, long runs of encoding characters are
tested for randomness under the encoding that they look like: chi-squared
uniformity over its alphabet, runs about the middle of the alphabet, and serial
correlation of neighbours.  Fisher's method combines the three p-values.

Random strings have uniform p-values, words and paths have tiny ones.  So in
each class of lengths the number of random strings follows from the upper half
of the p-values, and the class's cut is the lowest one above which the
estimated share of false discoveries stays within FDR.  Short strings give the
tests less power; their classes get higher cuts by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.llm.scratch import Scratch

#: Base patterns, in the order in which kinds are listed, with their shortest length (of the value or the match).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]
ASSIGN_VALUE = 8

#: Runs of encoding characters that are tested, and the largest accepted share of false discoveries.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
FDR = 0.01
#: Upper ends of the length classes, and bins of p-values.
LENGTHS = [23, 27, 31, 39, 47, 63, 95, 159]
BINS = 1000

_ALPHABET = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
_PIECE = "array<struct<kind:int,pos:int,gap:int,len:int,kept:boolean,p:double>>"


def find_pieces(text: Column, pattern: str, kind: int, value: int | None = None, least: int = 0, p=None) -> Column:
    """Leftmost non-overlapping matches in their order: code points since the match before, and of the match.

    Not ``kept`` are those whose group ``value`` is shorter than ``least``; ``p`` is worked out from a match's characters.
    """
    regex = F.lit(pattern)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    inner = F.regexp_extract_all(text, regex, F.lit(value)) if value is not None else found
    rows = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("s"), inner.alias("v")), lambda r: r["s"].isNotNull())
    out = F.transform(rows, lambda r, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("pos"), F.length(r["gap"]).alias("gap"), F.length(r["s"]).alias("len"),
        (F.length(r["v"]) >= least).alias("kept"), (p(r["s"]) if p else F.lit(None)).cast("double").alias("p")))
    return F.when(text.rlike(pattern), out).otherwise(F.array()).cast(_PIECE)


def place(pieces: DataFrame) -> DataFrame:
    """Spans (uid, kind, start, end, p) of pieces (uid, kind, pos, gap, len, kept, p); candidates that touch a base span go.

    Positions are running sums, and a candidate looks at the furthest end of the
    base spans that start before it ends, so the work follows the matches of a
    text, however many there are.
    """
    along = Window.partitionBy("uid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = pieces.repartition("uid").withColumn("end", F.sum(F.col("gap") + F.col("len")).over(along)).withColumn("start", F.col("end") - F.col("len"))
    base = F.col("kind") < 3
    x = x.where(F.col("kept") & (base | F.col("p").isNotNull()))
    before = Window.partitionBy("uid").orderBy(F.when(base, F.col("start")).otherwise(F.col("end")), base).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("reach", F.max(F.when(base, F.col("end"))).over(before))
    return x.where(base | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).select("uid", "kind", "start", "end", "p")


def upper_tail(z: Column) -> Column:
    """P(N > z) of the standard normal (rational approximation, error below 1e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))


def battery(s: Column) -> Column:
    """p-value of randomness for one candidate; null if it looks like no encoding (too few kinds of characters)."""
    bare = F.regexp_replace(s, "[-=]", "")
    kinds = sum(F.when(s.rlike(c), 1).otherwise(0) for c in ("[A-Z]", "[a-z]", "[0-9]"))
    enc = (F.when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(s.rlike("^[A-Z2-7]+=*$"), "base32").otherwise("base64"))
    core = F.when(enc == "hex", F.lower(bare)).when(enc == "base32", bare).otherwise(F.translate(F.rtrim(s, F.lit("=")), "-_=", "+/"))

    def locate(alphabet: Column, x: Column) -> Column:
        return (F.position(x, alphabet) - 1).cast("double")

    def with_codes(c: Column) -> Column:
        core, k, alphabet = c["core"], c["k"], c["alphabet"]
        chars = F.filter(F.split(core, ""), lambda x: x != "")
        return F.struct(core.alias("core"), k.alias("k"), F.size(chars).cast("double").alias("n"), F.array_distinct(chars).alias("kinds"),
                        F.transform(chars, lambda x: locate(alphabet, x)).alias("code"))

    def sums(c: Column) -> Column:
        n, code = c["n"], c["code"]
        m = n.cast("int")
        mean = _sum(code, lambda x: x) / n
        pairs = F.zip_with(F.slice(code, F.lit(1), m - 1), F.slice(code, F.lit(2), m - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        half = c["k"] / 2
        return F.struct(
            n.alias("n"), c["k"].alias("k"),
            _sum(c["kinds"], lambda x: F.pow(F.length(c["core"]) - F.length(F.replace(c["core"], x, F.lit(""))), F.lit(2.0))).alias("squares"),
            _sum(code, lambda x: F.when(x >= half, 1.0).otherwise(0.0)).alias("high"),
            _sum(pairs, lambda p: F.when((p["x"] >= half) != (p["y"] >= half), 1.0).otherwise(0.0)).alias("turns"),
            _sum(pairs, lambda p: (p["x"] - mean) * (p["y"] - mean)).alias("co"),
            _sum(code, lambda x: (x - mean) * (x - mean)).alias("var"))

    def p_value(c: Column) -> Column:
        n, k = c["n"], c["k"]
        df = k - 1
        chi = c["squares"] * k / n - n
        p1 = upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        mean = 2 * c["high"] * (n - c["high"]) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p2 = F.when(spread > 0, 2 * upper_tail(F.abs(c["turns"] + 1 - mean) / F.sqrt(spread))).otherwise(F.lit(0.0))
        p3 = F.when(c["var"] > 0, 2 * upper_tail(F.abs(c["co"] / c["var"] + 1 / (n - 1)) * F.sqrt(n))).otherwise(F.lit(0.0))
        x = -sum(F.log(F.greatest(p, F.lit(1e-12))) for p in (p1, p2, p3))
        return F.exp(-x) * (1 + x + x * x / 2)  # chi-squared with 6 degrees of freedom

    start = F.struct(core.alias("core"), F.when(enc == "hex", 16.0).when(enc == "base32", 32.0).otherwise(64.0).alias("k"),
                     F.when(enc == "hex", _ALPHABET["hex"]).when(enc == "base32", _ALPHABET["base32"]).otherwise(_ALPHABET["base64"]).alias("alphabet"))
    # a one-element array gives each step's result a name
    steps = F.transform(F.transform(F.transform(F.array(start), with_codes), sums), p_value)
    return F.when((kinds >= 2) & (F.length(core) >= 16), F.element_at(steps, 1))


def length_class(n: Column) -> Column:
    out = F.lit(len(LENGTHS))
    for i, top in reversed(list(enumerate(LENGTHS))):
        out = F.when(n <= top, i).otherwise(out)
    return out


def cuts(tested: DataFrame) -> list[float]:
    """Per length class the p-value from which a candidate is a secret (2: none), from all tested candidates (cls, p)."""
    by = Window.partitionBy("cls").orderBy(F.desc("bin"))
    h = tested.groupBy("cls", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upper = Window.partitionBy("cls")
    h = h.withColumn("above", F.sum("n").over(by)).withColumn("random", 2 * F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).over(upper))
    wrong = F.col("above") - F.col("random") * (1 - F.col("bin") / BINS)
    h = h.where((F.col("random") > 0) & (wrong <= FDR * F.col("above"))).groupBy("cls").agg(F.min("bin").alias("bin"))
    out = [2.0] * (len(LENGTHS) + 1)
    for r in h.collect():  # a row per length class
        out[r["cls"]] = max(float(r["bin"]) / BINS, 1.0 / BINS)
    return out


def _text(kinds: Column) -> Column:
    """``kind:start:end`` of a row's spans of these kinds, by start and then kind, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    spans = F.array_sort(F.collect_list(F.when(kinds, F.struct("start", "kind", "end"))))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Secrets in each document of ``docs`` (doc_id, text).

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans,
    ``kind:start:end`` by start and then kind, in code points, end exclusive)
    and spans (base spans and strings that pass the battery, kind ``random``,
    where they touch no base span).

    A null or empty text has no spans.  A text's matches are rows of their own,
    so a long text with very many takes time in proportion.  Repeated rows give
    a row each.  Other columns are ignored.  An empty table, or one without
    candidates, has no random spans.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    t, kind = F.col("text"), F.col("kind")
    x = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = F.concat(find_pieces(t, ASSIGN, 0, 1, ASSIGN_VALUE), find_pieces(t, ACCESS, 1), find_pieces(t, HEX, 2), find_pieces(t, CANDIDATE, 3, p=battery))
    x = scratch.keep(x.select("uid", "doc_id", found.alias("pieces")), "pieces")
    spans = scratch.keep(place(x.select("uid", F.inline("pieces"))), "spans")
    cls = length_class(F.col("end") - F.col("start"))
    limit = F.array(*(F.lit(c) for c in cuts(spans.where(kind == 3).select(cls.alias("cls"), "p"))))
    spans = spans.where((kind < 3) | (F.col("p") >= F.element_at(limit, cls + 1)))
    spans = spans.groupBy("uid").agg(*(F.count_if(kind == i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])), _text(kind < 3).alias("base"), _text(kind <= 3).alias("spans"))
    none = F.lit("")
    return x.select("uid", "doc_id").join(spans, "uid", "left").select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.coalesce("base", none), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans"))
