"""Token counts of a unigram vocabulary without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character; dynamic programming carries the best score and its number of pieces.
Ties follow the tokenizer: the path whose last piece begins first stays.  A
character that is no piece costs the lowest score less UNKNOWN and counts its
UTF-8 bytes (byte fallback).

No piece continues over a blank or contains a line end, so the parts of a text
between them are counted on their own, and each different part once per worker
(up to MEMO_PARTS parts of at most MEMO_CHARS characters).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the tokenizer: the mark of a blank, and what an unknown character costs beyond the lowest score.
BLANK, UNKNOWN = "▁", 10.0
MEMO_PARTS, MEMO_CHARS = 300_000, 64

_PARTS = re.compile(" +[^ ]*")


@lru_cache(2)
def pieces(model_file: str) -> tuple[tuple[str, float], ...]:
    """(piece, score) of every piece of a sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return tuple((sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()))


class Counter:
    """Counts the pieces of the best segmentation."""

    def __init__(self, vocab: tuple[tuple[str, float], ...]) -> None:
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in dict(vocab).items():
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.single = {p for p, _ in vocab if len(p) == 1}
        self.unknown = min(s for _, s in vocab) - UNKNOWN
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p, _ in vocab):
            raise ValueError("a piece of the vocabulary runs over a blank or a line end")
        self.memo: dict[str, int] = {}

    def best(self, s: str) -> int:
        """Pieces of the best path through ``s`` (blanks already marked)."""
        n = len(s)
        score, count, first = [0.0] + [float("-inf")] * n, [0] * (n + 1), [n] * (n + 1)
        reached = 0  # unknown characters up to here are entered

        def unknown(end: int) -> None:
            c = s[end - 1]
            if c not in self.single and (x := score[end - 1] + self.unknown) > score[end]:
                score[end], count[end], first[end] = x, count[end - 1] + len(c.encode()), end - 1

        for at, (size, gain) in self.auto.iter(s):
            end = at + 1
            while reached < at:
                reached += 1
                unknown(reached)
            start = end - size
            x = score[start] + gain
            if x > score[end] or (x == score[end] and start < first[end]):
                score[end], count[end], first[end] = x, count[start] + 1, start
        while reached < n:
            reached += 1
            unknown(reached)
        return count[n]

    def part(self, p: str) -> int:
        """Pieces of a blank run with what follows it up to the next blank; line ends are unknown characters of one byte."""
        head, *rest = p.replace(" ", BLANK).split("\n")
        return self.best(head) + sum(1 + self.best(r) for r in rest)

    def text(self, t: str | None) -> int:
        if not t:
            return 0
        memo, total = self.memo, 0
        plain = "  " not in t and t[0] != " "
        for w in t.split(" ") if plain else _PARTS.findall(" " + t):
            w = " " + w if plain else w
            n = memo.get(w)
            if n is None:
                n = self.part(w)
                if len(w) <= MEMO_CHARS:
                    if len(memo) >= MEMO_PARTS:
                        memo.clear()
                    memo[w] = n
            total += n
        return total


@lru_cache(2)
def counter(model_file: str) -> Counter:
    return Counter(pieces(model_file))


def _count(model_file: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_file)
        for b in batches:
            n = [c.text(b.column("text")[i].as_py()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])
    return run


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id and n_tokens of each document of ``docs`` (doc_id, text).

    The text is segmented with a blank before it, under the pieces and scores
    of ``model_file`` as a unigram vocabulary with byte fallback.  A null or
    empty text has no tokens.  Repeated rows give a row each.  Other columns
    are ignored.
    """
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return x.mapInArrow(_count(model_file), "doc_id long, n_tokens long")
