"""BPE encoding and decoding by a depth-first walk over a trie of words.

The encoding of a text's beginning ends with one token, and what stands before
that token is the encoding of the shorter beginning.  So a trie of words needs
one token per node: the last one of the encoding of the node's path.  The
distinct words of a batch are walked in sorted order, which is depth first;
a beginning that words share is worked out once, and the tokens of a word are
read off by jumping from its node back over one token after another.

A token can be the last one at a node if it is a suffix of the path and stands
next to the last token of what remains without being merged across the border
(:meth:`Vocabulary.apart`); exactly one suffix does.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm import tokens

#: Bounds of what a worker keeps between batches: trie nodes, bytes of remembered words and of remembered pieces, border decisions.
MAX_NODES, MEMO_BYTES, PIECE_BYTES, MAX_BORDERS = 600_000, 96 << 20, 64 << 20, 400_000
#: Longer pieces and words are encoded without being kept.
KEPT_CHARS = 64
_NEVER = 1 << 60


class Vocabulary:
    """Merges and pieces of a BPE file of the tokenizers library.

    Needs a plain BPE model (no dropout, unknown token or byte fallback) whose
    merges stand in the order of training, over byte-level characters, and a
    decoder that is absent or byte-level; anything else raises ValueError.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"not a plain BPE vocabulary: {path} {odd}")
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self._read_merges([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self._read_added(spec.get("added_tokens") or [])
        self._read_decoder(spec.get("decoder"))
        self.wordwise = all(spec[k] == v for k, v in tokens._WORDWISE.items()) and not any(re.search(r"\s", a) for a in self.added)
        self.borders: dict[int, bool] = {}

    def _read_merges(self, merges: list[tuple[str, str]]) -> None:
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        chars = tokens._byte_chars().values()
        for c in map(chr, chars):
            for s in {c, c + self.suffix}:
                if s not in self.ids:
                    raise ValueError(f"the vocabulary lacks the symbol {s!r}")
                self.born[self.ids[s]] = -1
        split: dict[int, tuple[int, int]] = {}
        pairs = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in merges]
        for r, (a, b, _) in enumerate(pairs):
            self.rank.setdefault((a, b), r)
        # what touches a token's left and right border over time, as (token, the merge that ends it), innermost first
        self.left: dict[int, list[tuple[int, int]]] = {t: [(t, _NEVER)] for t in self.born}
        self.right: dict[int, list[tuple[int, int]]] = {t: [(t, _NEVER)] for t in self.born}
        for r, (a, b, t) in enumerate(pairs):
            if t in split or a not in self.born or b not in self.born or self.rank[a, b] != r:
                continue  # an encoding never gets to this token in this way
            if max(self.born[a], self.born[b]) >= r:
                raise ValueError("the merges don't stand in the order of training")
            if self._crossing(a, b) != (a, b):
                continue
            split[t], self.born[t] = (a, b), r
            self.left[t] = [*self.left[a][:-1], (a, r), (t, _NEVER)]
            self.right[t] = [*self.right[b][:-1], (b, r), (t, _NEVER)]
        inner = {s: i for s, i in self.ids.items() if i in self.born and not (self.suffix and s.endswith(self.suffix))}
        final = {s.removesuffix(self.suffix): i for s, i in self.ids.items() if i in self.born and s.endswith(self.suffix)}
        self.inner, self.final = inner, final if self.suffix else inner
        # every beginning of a piece, with the inner pieces that end it, longest first
        starts = {s[:k] for s in inner for k in range(1, len(s) + 1)} | {s[:k] for s in self.final for k in range(1, len(s))}
        self.ends = {s: tuple((inner[e], len(e)) for k in range(len(s)) if (e := s[k:]) in inner) for s in starts}
        self.length = {i: len(s) for d in (inner, self.final) for s, i in d.items()}

    def _read_added(self, added: list[dict]) -> None:
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError("added tokens that strip, want whole words or are normalised aren't supported")
        self.added = {a["content"]: a["id"] for a in added}
        self.added_re = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def _read_decoder(self, decoder: dict | None) -> None:
        if decoder and decoder["type"] != "ByteLevel":
            raise ValueError(f"decoder {decoder['type']} isn't supported")
        words = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.added.items()}
        if decoder is None:  # the library joins the pieces by blanks
            self.between, self.piece = b" ", {i: s.encode() for i, s in words.items()}
        else:
            back = {chr(c): b for b, c in tokens._byte_chars().items()}
            self.between = b""
            self.piece = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for i, s in words.items()}

    def _crossing(self, s: int, t: int) -> tuple[int, int] | None:
        """The first merge across the border of two tokens side by side, as the pair that it joins."""
        right, left = self.right[s], self.left[t]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            r = self.rank.get((x, y))
            # of equal merges the leftmost comes first: one inside s before, one inside t after the border's
            if r is not None and r < x_ends and r <= y_ends:
                return x, y
            if x_ends == _NEVER == y_ends:
                return None
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def apart(self, s: int, t: int) -> bool:
        """Whether token t right after token s stays a token of its own."""
        key = s << 32 | t
        known = self.borders.get(key)
        if known is None:
            if len(self.borders) >= MAX_BORDERS:
                self.borders.clear()
            known = self.borders[key] = self._crossing(s, t) is None
        return known

    def last(self, piece: str, n: int, path: list[int], depth: int) -> tuple[int, int]:
        """Last token of the first n characters within a word, and the length of their longest end that begins a piece.

        ``path[k]`` is the last token of the first k characters, ``depth`` that
        length for n - 1 characters: it grows by one at most.
        """
        ends = self.ends
        for size in range(min(n, depth + 1), 0, -1):
            if (found := ends.get(piece[n - size:n])) is not None:
                for t, m in found:
                    if m == n or self.apart(path[n - m], t):
                        return t, size
        raise ValueError(f"no token ends {piece[:n]!r}")  # can't be: single symbols are tokens

    def final_token(self, piece: str, path: list[int], depth: int) -> int:
        """Last token of a whole word; ``path`` and ``depth`` of all but its last character."""
        n = len(piece)
        for size in range(min(n, depth + 1), 0, -1):
            t = self.final.get(piece[n - size:])
            if t is not None and (size == n or self.apart(path[n - size], t)):
                return t
        raise ValueError(f"no token ends {piece!r}")


class Trie:
    """The beginnings of words, with the last token of each."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.token, self.depth = array("i", [-1]), array("H", [0])

    def encode(self, pieces: list[str]) -> dict[str, list[int]]:
        """Token ids of distinct pieces (each one word of the model), shared beginnings worked out once."""
        out: dict[str, list[int]] = {}
        vocab, nodes, path, before = self.vocab, [0], [-1], ""
        child, token, depth = self.child, self.token, self.depth
        for piece in sorted(pieces):
            n = len(piece)
            if n > KEPT_CHARS:
                out[piece] = self._alone(piece)
                continue
            if len(token) > MAX_NODES:
                self.clear()
                nodes, path, before = [0], [-1], ""
                child, token, depth = self.child, self.token, self.depth
            k, top = 0, min(n, len(before)) - 1
            while k < top and piece[k] == before[k]:
                k += 1
            del nodes[k + 1:], path[k + 1:]
            node = nodes[k]
            for k in range(k + 1, n):
                key = node << 21 | ord(piece[k - 1])
                new = child.get(key)
                if new is None:
                    t, d = vocab.last(piece, k, path, depth[node])
                    new = child[key] = len(token)
                    token.append(t)
                    depth.append(d)
                node = new
                nodes.append(node)
                path.append(token[node])
            out[piece] = self._read(path, n, vocab.final_token(piece, path, depth[node]))
            before = piece
        return out

    def _alone(self, piece: str) -> list[int]:
        path, d = [-1], 0
        for k in range(1, len(piece)):
            t, d = self.vocab.last(piece, k, path, d)
            path.append(t)
        return self._read(path, len(piece), self.vocab.final_token(piece, path, d))

    def _read(self, path: list[int], n: int, t: int) -> list[int]:
        """Ids of a word of n characters that ends with token t, from its last token back."""
        ids, length = [t], self.vocab.length
        while n := n - length[t]:
            t = path[n]
            ids.append(t)
        return ids[::-1]


class Codec:
    """Whole texts to ids and back, as the library does it without special tokens, truncation and padding."""

    def __init__(self, path: str) -> None:
        self.vocab = Vocabulary(path)
        self.trie = Trie(self.vocab)
        self.memo: dict[str, bytes] = {}
        self.kept = 0
        self.known: dict[str, bytes] = {}
        self.known_kept = 0
        self.chars = tokens._byte_chars()

    def _pieces(self, text: str) -> list[str]:
        """The model's words of a text, by the file's normaliser and pre-tokeniser."""
        if self.vocab.wordwise and (m := tokens._LETTERS.fullmatch(text)):
            word, signs = m.groups()
            word = word.lower().encode().decode("latin-1").translate(self.chars)
            return [word, signs] if signs else [word]
        t = self.vocab.tok
        if t.normalizer:
            text = t.normalizer.normalize_str(text)
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(text)] if t.pre_tokenizer else [text] * bool(text)

    def _cut(self, text: str) -> list[str | int]:
        """Pieces of a text; the ids of added tokens stand between them."""
        if not self.vocab.added_re:
            return self._pieces(text)
        out: list[str | int] = []
        for k, part in enumerate(self.vocab.added_re.split(text)):
            if k % 2:
                out.append(self.vocab.added[part])
            elif part:
                out += self._pieces(part)
        return out

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of new words; their pieces that other words had go through the trie once."""
        cut = {w: self._cut(w) for w in words}
        known = self.known
        new = self.trie.encode(list({p for ps in cut.values() for p in ps if isinstance(p, str) and p not in known}))
        fresh = {p: array("I", ids).tobytes() for p, ids in new.items()}

        def coded(p: str | int) -> bytes:
            if isinstance(p, int):
                return array("I", (p,)).tobytes()
            return fresh[p] if p in fresh else known[p]

        out = {w: coded(ps[0]) if len(ps) == 1 else b"".join([coded(p) for p in ps]) for w, ps in cut.items()}
        for p, ids in fresh.items():
            if len(p) <= KEPT_CHARS:
                if self.known_kept > PIECE_BYTES:
                    known.clear()
                    self.known_kept = 0
                known[p] = ids
                self.known_kept += 150 + len(p) + len(ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        words = [t.replace("\n", " ").split(" ") if self.vocab.wordwise else [t] for t in texts]
        memo = self.memo
        new = self._learn({w for t in words for w in t if w not in memo})
        out = [b"".join([memo[w] if w in memo else new[w] for w in t]) for t in words]
        for w, ids in new.items():
            if len(w) <= KEPT_CHARS:
                if self.kept > MEMO_BYTES:
                    memo.clear()
                    self.kept = 0
                memo[w] = ids
                self.kept += 150 + len(w) + len(ids)
        return out

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8; ids that the vocabulary lacks are left out, as the library does."""
        known = self.vocab.piece
        text = self.vocab.between.join([known[i] for i in np.frombuffer(ids, "<u4").tolist() if i in known])
        return text if self.vocab.between else text.decode("utf-8", "replace").encode()


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encode(vocab: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab)
        for b in batches:
            for ids, texts in tokens._steps(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                coded = c.encode(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(coded, pa.binary())], ["doc_id", "n_tokens", "ids"])
    return run


def _decode(vocab: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab)
        for b in batches:
            texts = [c.decode(x or b"").decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return run


def _digest(vocab: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab)
        for b in _encode(vocab)(batches):
            coded = b.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_tokens"), pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                 pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in coded])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, vocab: str) -> DataFrame:
    """(doc_id, n_tokens long, ids binary) of each whole text: ids as little-endian unsigned 32-bit integers.

    ``docs``: doc_id long, text string; other columns, whatever their names,
    are ignored.  A null or empty text has no ids, a null doc_id stays null,
    repeated rows are encoded each; an empty table gives an empty one.  One
    pass without a shuffle: each task builds the trie of its own words and
    keeps it, within fixed bounds, for its next batches.
    """
    return _texts(docs).mapInArrow(_encode(vocab), "doc_id long, n_tokens long, ids binary")


def decode(coded: DataFrame, vocab: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id long, ids binary) as :func:`encode` gives them; null ids give an empty text."""
    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(_decode(vocab), "doc_id long, text string")


def digests(docs: DataFrame, vocab: str) -> DataFrame:
    """Per row of ``docs``, encoded and decoded again: doc_id, n_tokens, SHA-256 of the ids and of the decoded text (see :func:`encode`)."""
    return _texts(docs).mapInArrow(_digest(vocab), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
