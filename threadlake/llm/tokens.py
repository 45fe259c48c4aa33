"""Token ids in fixed-width bit-packed files.

A shard holds the ids of a range of documents in the fewest bits that the
vocabulary needs.  Ids are packed in blocks that start at a byte of their own,
so any range of ids is read by seeking to its blocks and unpacking them with
numpy.  Layout (little-endian):

    magic 8 bytes | blocks, one after another | block offsets int64 (blocks + 1)
    | doc ids int64 | doc id known uint8 | first id of each doc int64 (docs + 1)
    | footer: width, ids per block, blocks, docs, ids (int64 each) | magic

Everything that a writer keeps in memory is one block and the document table.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.scratch import Scratch

MAGIC = b"TLIDS\x00\x00\x01"
BLOCK_IDS = 1 << 16
#: Words whose ids a worker remembers, and the characters of the longest of them.
MEMO_WORDS, MEMO_CHARS = 500_000, 64
#: Characters encoded at once.
STEP_CHARS = 1 << 20


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2^width, width bits each, lowest bit first, padded to a byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=width)
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """The first n ids of :func:`pack`, as uint32."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros((n, 32), np.uint8)
    out[:, :width] = bits
    return np.packbits(out, axis=1, bitorder="little").view("<u4").reshape(n)


class ShardWriter:
    """Streams documents into one shard; the file gets its name only when it is complete."""

    def __init__(self, uri: str, width: int, attempt: str) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.part = f"{os.path.dirname(self.path)}/_{os.path.basename(self.path)}.{attempt}"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.out.write(MAGIC)
        self.width, self.at, self.offsets = width, len(MAGIC), []
        self.wait: list[np.ndarray] = []
        self.waiting = self.ids = 0
        self.doc_ids: list[int | None] = []
        self.first: list[int] = []

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.at += self.out.write(pack(ids, self.width))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.first.append(self.ids)
        self.ids += len(ids)
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 8 * BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        x = np.concatenate(self.wait) if self.wait else np.zeros(0, np.uint32)
        end = len(x) if last else len(x) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, end, BLOCK_IDS):
            self._block(x[i:min(i + BLOCK_IDS, end)])
        self.wait = [x[end:]]
        self.waiting = len(x) - end

    def close(self) -> tuple[int, int]:
        self._flush(True)
        for x in (
            np.array([*self.offsets, self.at], "<i8"), np.array([d or 0 for d in self.doc_ids], "<i8"),
            np.array([d is not None for d in self.doc_ids], np.uint8), np.array([*self.first, self.ids], "<i8"),
            np.array([self.width, BLOCK_IDS, len(self.offsets), len(self.doc_ids), self.ids], "<i8"),
        ):
            self.out.write(x.tobytes())
        self.out.write(MAGIC)
        self.out.close()
        self.fs.move(self.part, self.path)
        return len(self.doc_ids), self.ids


class Shard:
    """Random access to one shard."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(48, size - 48)
        if tail[40:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"not a complete shard: {uri}")
        self.width, self.block, blocks, docs, self.ids = np.frombuffer(tail, "<i8", 5).tolist()
        table = self.file.read_at(8 * (blocks + 1) + 17 * docs + 8, size - 48 - 8 * (blocks + 1) - 17 * docs - 8)
        cut = np.cumsum([0, 8 * (blocks + 1), 8 * docs, docs])
        self.offsets = np.frombuffer(table, "<i8", blocks + 1, cut[0])
        self.doc_ids = np.frombuffer(table, "<i8", docs, cut[1])
        self.known = np.frombuffer(table, np.uint8, docs, cut[2]).astype(bool)
        self.first = np.frombuffer(table, "<i8", docs + 1, cut[3])

    def read(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the shard; reads only their blocks."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        a, b = lo // self.block, (hi - 1) // self.block
        data = self.file.read_at(int(self.offsets[b + 1] - self.offsets[a]), int(self.offsets[a]))
        out = []
        for k in range(a, b + 1):
            n = min(self.block, self.ids - k * self.block)
            out.append(unpack(data[self.offsets[k] - self.offsets[a]:self.offsets[k + 1] - self.offsets[a]], n, self.width))
        x = np.concatenate(out)
        return x[lo - a * self.block:hi - a * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.read(int(self.first[i]), int(self.first[i + 1]))


#: Normaliser and pre-tokeniser (fixed values of the vocabulary file) under which words between blanks are
#: encoded alone, and a word of letters is one piece of the model.
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: A word of letters, with the signs after it (without the apostrophe, which can begin a piece of letters).
_LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")


def _byte_chars() -> dict[int, int]:
    """Byte -> character of byte-level vocabularies: printable Latin-1 stays, the others follow from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = (b for b in range(256) if b not in keep)
    return {b: b for b in keep} | {b: 256 + i for i, b in enumerate(other)}


class Encoder:
    """Ids of whole texts with the tokenizers library, as uint32 arrays.

    Where the vocabulary file encodes words between blanks on their own, each
    distinct word is encoded once and remembered (up to MEMO_WORDS of at most
    MEMO_CHARS characters).
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.wordwise = all(spec[k] == v for k, v in _WORDWISE.items())
        self.model = self.tok.model
        self.chars = _byte_chars()
        self.memo: dict[str, bytes] = {}
        self.end: dict[str, bytes] = {"": b""}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        rest, tokenize, end_of = [], self.model.tokenize, self.end
        for w in words:
            if len(w) <= MEMO_CHARS and (m := _LETTERS.fullmatch(w)):
                word, end = m.groups()
                if end not in end_of:
                    if len(end_of) > MEMO_WORDS:
                        end_of.clear()
                        end_of[""] = b""
                    end_of[end] = self._plain([end])[0]
                pieces = tokenize(word.lower().encode().decode("latin-1").translate(self.chars))
                self.memo[w] = array("I", [t.id for t in pieces]).tobytes() + end_of[end]
            else:
                rest.append(w)
        self.memo.update(zip(rest, self._plain(rest), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.wordwise:
            return [np.frombuffer(b, "<u4") for b in self._plain(texts)]
        words = [t.replace("\n", " ").split(" ") for t in texts]
        memo = self.memo
        parts = [list(map(memo.get, t)) for t in words]
        new = {w for t, ps in zip(words, parts, strict=True) for w, p in zip(t, ps, strict=True) if p is None}
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
        self._learn(list(new))
        out = [np.frombuffer(b"".join([memo[w] if p is None else p for w, p in zip(t, ps, strict=True)]), "<u4") for t, ps in zip(words, parts, strict=True)]
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _steps(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[str]]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= STEP_CHARS:
            yield ids[lo:i + 1], [x or "" for x in texts[lo:i + 1]]
            lo, size = i + 1, 0
    if lo < len(ids):
        yield ids[lo:], [x or "" for x in texts[lo:]]


def _write(path: str, vocab: str, width: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        uri = f"{path}/ids-{ctx.partitionId():08d}.bin"
        enc, out = encoder(vocab), None
        last = np.array([end_id], np.uint32)
        for b in batches:
            for ids, texts in _steps(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                out = out or ShardWriter(uri, width, f"{ctx.taskAttemptId()}")
                for d, x in zip(ids, enc.encode(texts), strict=True):
                    out.add(d, np.append(x, last))
        if out:
            docs, n = out.close()
            yield pa.RecordBatch.from_pylist([{"shard": ctx.partitionId(), "uri": uri, "docs": docs, "ids": n}])
    return run


def write_ids(docs: DataFrame, vocab: str, path: str, end_id: int) -> DataFrame:
    """Encode every whole text (null: empty), append ``end_id`` and write shards in ascending doc_id order.

    ``docs``: doc_id long, text string; other columns are ignored.  Returns
    the manifest: shard, uri, docs, ids and ``start``, the ids of all shards
    before.  Documents without an id come first; rows with equal ids stand
    together, in the order of a hash of their texts, so one hot id can span
    shards.  An empty table writes no shard.  ``path`` must be one that all
    executors reach.  A task that is run again writes the same file again.
    """
    spark = docs.sparkSession
    n = _vocab_size(vocab)
    width = max(1, (max(n - 1, end_id)).bit_length())
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    x = x.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    rows = x.mapInArrow(_write(path, vocab, width, end_id), "shard long, uri string, docs long, ids long").toArrow().to_pylist()  # a row per file
    start = 0
    for r in sorted(rows, key=lambda r: r["shard"]):
        r["start"] = start
        start += r["ids"]
    return spark.createDataFrame([tuple(r[c] for c in ("shard", "uri", "docs", "ids", "start")) for r in rows], "shard long, uri string, docs long, ids long, start long")


@lru_cache(4)
def _vocab_size(vocab: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab).get_vocab_size(with_added_tokens=True)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            s = Shard(r["uri"])
            lo, docs = 0, len(s.doc_ids)
            while lo < docs:
                hi = max(lo + 1, int(np.searchsorted(s.first, s.first[lo] + 16 * BLOCK_IDS, "right")) - 1)
                hi = min(hi, docs)
                x = s.read(int(s.first[lo]), int(s.first[hi]))
                f = s.first[lo:hi + 1] - s.first[lo]
                crc = [zlib.crc32(x[f[i]:f[i + 1]].astype("<u4").tobytes()) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids[lo:hi], pa.int64(), mask=~s.known[lo:hi]), pa.array(s.first[lo:hi] + r["start"]),
                     pa.array(np.diff(f)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                lo = hi


def read_digests(manifest: DataFrame) -> DataFrame:
    """Per document of the written shards: doc_id, start, n_tokens, ids_crc32, read back from the files."""
    n = max(1, min(manifest.count(), 1 << 16))
    return manifest.select("uri", "start").repartition(n, "uri").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, vocab: str, end_id: int) -> DataFrame:
    """Write ``docs`` as shards under the shared folder and return the digests read back."""
    path = Scratch(docs.sparkSession, "token-ids").path
    return read_digests(write_ids(docs, vocab, path if "://" in path or path.startswith("/") else path.replace("file:", "", 1), end_id))
