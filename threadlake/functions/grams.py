"""Gram tokenizers and packed keys, as JVM-side higher-order expressions.

Every function returns a Column, so the work runs inside the scan stage on
the executors (no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions._util import as_col

# Fixed values that must equal the reference's behaviour.
# Characters the title n-gram tokenizer keeps (everything else is removed).
NGRAM_CLEAN_RE = r"[^A-Za-z0-9ㄱ-ㅎㅏ-ㅣ가-힣~!?.,():;*/=+\-\[\]\s\n<>]"
# Characters vgram keeps before splitting on single spaces.
VGRAM_CLEAN_RE = r"[^A-Za-z가-힣ㅏ-ㅣㄱ-ㅎ0-9*;(),.@~#\s]"
NGRAM_MIN, NGRAM_MAX = 1, 10
VGRAM_MIN, VGRAM_MAX = 2, 20
# Word splitter of the ``default`` title tokenizer.
WORD_SPLIT_RE = r"[^\p{L}\p{N}]+"


def clean_chars(c) -> Column:
    return F.regexp_replace(as_col(c), NGRAM_CLEAN_RE, "")


def _substrings(s: Column, lo: int, hi: int) -> Column:
    """array<struct<pos:int, gram:string>> of every substring with length in [lo, hi]."""
    n = F.length(s)

    def at(i: Column) -> Column:
        lens = F.filter(F.sequence(F.lit(1), F.least(F.lit(hi), n - i + 1)), lambda ln: ln >= lo)
        return F.transform(lens, lambda ln: F.struct(i.alias("pos"), s.substr(i, ln).alias("gram")))

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), at))).otherwise(
        F.array().cast("array<struct<pos:int,gram:string>>")
    )


def ngram_tokens(c, min_gram: int = NGRAM_MIN, max_gram: int = NGRAM_MAX, lower: bool = True) -> Column:
    """Title n-gram tokens with start positions (1-based), over the whole field.

    Grams are cut from the raw text, then each token passes the character
    filter (and the lower-case filter when ``lower``); tokens left empty are
    dropped.  ``lower=False`` is the variant without the lower-case filter.
    """
    def norm(t: Column) -> Column:
        g = F.regexp_replace(t["gram"], NGRAM_CLEAN_RE, "")
        if lower:
            g = F.lower(g)
        return F.struct(t["pos"].alias("pos"), g.alias("gram"))

    toks = F.transform(_substrings(as_col(c), min_gram, max_gram), norm)
    return F.filter(toks, lambda t: F.length(t["gram"]) > 0)


def ngrams(c, min_gram: int = NGRAM_MIN, max_gram: int = NGRAM_MAX, lower: bool = True) -> Column:
    """Sorted distinct n-gram terms of a field."""
    toks = ngram_tokens(c, min_gram, max_gram, lower)
    return F.array_sort(F.array_distinct(F.transform(toks, lambda t: t["gram"])))


def vgram(c, min_gram: int = VGRAM_MIN, max_gram: int = VGRAM_MAX, first_only: bool = False) -> Column:
    """Sorted distinct substrings (length in [min, max]) of each space-separated word.

    Disallowed characters are removed first (all of them; ``first_only``
    removes only the first one, as a non-global replace would).  No grams ->
    NULL.
    """
    s = as_col(c)
    if first_only:
        cleaned = F.regexp_replace(s, r"(?s)^(.*?)" + VGRAM_CLEAN_RE, "$1")
    else:
        cleaned = F.regexp_replace(s, VGRAM_CLEAN_RE, "")
    words = F.split(cleaned, " ")
    grams = F.flatten(F.transform(words, lambda w: F.transform(_substrings(w, min_gram, max_gram),
                                                              lambda t: t["gram"])))
    out = F.array_sort(F.array_distinct(grams))
    return F.when(F.size(out) > 0, out)


def words(c) -> Column:
    """The ``default`` title tokenizer: split on non-alphanumerics, lower-case."""
    parts = F.split(F.lower(as_col(c)), WORD_SPLIT_RE)
    return F.filter(parts, lambda w: F.length(w) > 0)


def raw_token(c) -> Column:
    """The ``raw`` tokenizer: the whole field is one term."""
    return as_col(c)


def cat_and_time(cat, t) -> Column:
    """One sortable BIGINT for (category, time).

    High 32 bits: the first 8 hex digits of md5(category); low part: epoch
    seconds (rounded half-even).  The shift wraps to a negative number when
    the top bit is set, like a 64-bit signed shift.
    """
    head = F.conv(F.substring(F.md5(as_col(cat)), 1, 8), 16, 10).cast("long")
    secs = F.bround(F.unix_micros(as_col(t).cast("timestamp")) / F.lit(1_000_000)).cast("long")
    return F.shiftleft(head, 32) + secs
