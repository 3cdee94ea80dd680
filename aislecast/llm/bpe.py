"""Byte-level BPE encoding and decoding as streaming transducers.

Encoding: the text is read in chunks, cut into pieces by the split pattern as soon as a piece cannot change any more, and
pieces are merged by rank. A piece longer than a buffer is merged buffer by buffer: how far to the left an unseen byte
can reach is a constant of the merge list (``lookahead``, computed from chains of merges of rising rank that compete for
a token), so tokens further than that from the buffer's end are final and are emitted; the rest is read again with the next
bytes. Memory is constant: a chunk, a buffer and a bounded cache of merged pieces.
Decoding: tokens' bytes go through an incremental byte-to-text machine that keeps the bytes of an unfinished character.

Defined results: a null or empty text has no tokens and decodes to an empty text; strings of added tokens in a text are
those tokens; rows of one id are rows of their own; an empty table gives an empty result; bytes that are no UTF-8
decode to U+FFFD. Vocabularies are read from a file named by a parameter.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, held, in_workers, table

# fixed value: the split pattern of byte-level BPE
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.json"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def lookahead(merges: list[tuple[int, int, int]], size: dict[int, int]) -> int:
    """Bytes at the end of a buffer that unseen bytes can still change.

    A merge at the border takes or leaves its left token; a later merge that wants that token, or the merged one, as its
    right part then happens or not, which reaches its own left token, and so on. The longest such chain, in bytes.
    """
    reach: dict[int, int] = {}  # by right part: the longest chain that starts with a merge of a higher rank
    longest = 0
    for left, right, out in reversed(merges):
        far = size[left] + max(reach.get(left, 0), reach.get(out, 0))
        reach[right] = max(reach.get(right, 0), far)
        longest = max(longest, far)
    return longest


class Transducer:
    def __init__(self, vocabulary: bytes, chunk: int = 1 << 16, buffer: int = 512, cache: int = 250_000):
        spec = json.loads(vocabulary)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.of_byte = [0] * 256
        for token, i in ids.items():
            if len(token) == 1:
                self.of_byte[letters[token]] = i
        merges = []
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges.append((ids[a], ids[b], ids[a + b]))
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.out = [out for _, _, out in merges]
        self.lookahead = lookahead(merges, {i: len(b) for i, b in self.bytes.items()})
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.names = {i: str(i) for i in self.bytes}
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.chunk, self.buffer = chunk, buffer
        self.pieces = Cache(self._piece, cache, 64)

    def _merge(self, ids: list[int]) -> list[int]:
        """Merges by rank, the leftmost of equal ones first, until no pair is left."""
        rank, out, none = self.rank.get, self.out, len(self.out)
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)
            ids[i] = new = out[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], new), none)
            if i < len(ranks):
                ranks[i] = rank((new, ids[i + 1]), none)
        return ids

    def _piece(self, piece: str) -> tuple[int, ...]:
        return tuple(self._tokens(piece))

    def _tokens(self, piece: str) -> Iterator[int]:
        data = piece.encode("utf-8", "surrogatepass")
        of_byte, size = self.of_byte, self.bytes
        start = 0
        if len(data) <= self.buffer + self.lookahead:
            yield from self._merge([of_byte[b] for b in data])
            return
        while len(data) - start > self.buffer + self.lookahead:
            end = start + self.buffer + self.lookahead
            stable = end - self.lookahead
            for t in self._merge([of_byte[b] for b in data[start:end]]):
                if start + len(size[t]) > stable:
                    break
                start += len(size[t])
                yield t
        yield from self._merge([of_byte[b] for b in data[start:]])

    def _plain(self, text: str) -> Iterator[list[int]]:
        """Tokens of a text without added tokens, chunk by chunk."""
        at, n, take = 0, len(text), self.chunk
        pieces = self.pieces.__getitem__
        while at < n:
            part = text[at : at + take]
            words = self.split.findall(part)
            if at + take < n:  # a piece is final when the pattern has seen three characters more
                done = len(part)
                while words and len(part) - done < 3:
                    done -= len(words.pop())
                if not words:
                    take *= 2
                    continue
                at += done
            else:
                at = n
            take = self.chunk
            yield list(chain.from_iterable(map(pieces, words)))

    def encode(self, text: str) -> Iterator[list[int]]:
        at = 0
        if self.special:
            for m in self.special.finditer(text):
                yield from self._plain(text[at : m.start()])
                yield [self.added[m.group()]]
                at = m.end()
        yield from self._plain(text[at:] if at else text)

    def decode(self, ids: Iterable[list[int]]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        look = self.bytes.__getitem__
        for some in ids:
            yield machine.decode(b"".join(map(look, some)))
        yield machine.decode(b"", final=True)

    def digests(self, text: str, keep: list | None = None) -> tuple[int, str, str]:
        """(number of tokens, sha256 of the ids joined by commas, sha256 of the decoded text), as a stream.

        ``keep`` gets the ids, chunk by chunk.
        """
        named, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
        name, look = self.names.__getitem__, self.bytes.__getitem__
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in self.encode(text):
            if ids:
                named.update((("," if n else "") + ",".join(map(name, ids))).encode())
                n += len(ids)
                if keep is not None:
                    keep.append(np.array(ids, np.int32))
                decoded.update(machine.decode(b"".join(map(look, ids))).encode("utf-8"))
        decoded.update(machine.decode(b"", final=True).encode("utf-8"))
        return n, named.hexdigest(), decoded.hexdigest()


def transducer(vocabulary: bytes) -> Transducer:
    """The worker's transducer for a vocabulary."""
    return held(("bpe", hashlib.sha256(vocabulary).digest()), lambda: Transducer(vocabulary))


def read_vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file: a few MB whatever the corpus is, sent to the workers once."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


def _per_text(docs: DataFrame, make, names: list[str], types: list, path: str | None) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    schema = pa.schema([("doc_id", pa.int64()), *zip(names, types)])
    sql = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}

    def run(batches):
        t = transducer(sent.value)
        for batch in batches:
            out = [make(t, text.as_py() or "") for text in batch.column(1)]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out), types)] if out else [pa.array([], kind) for kind in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_workers(picked, run, ", ".join(["doc_id long", *(f"{n} {sql[k]}" for n, k in zip(names, types))]))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens): the token ids of every text."""

    def make(t, text):
        ids = list(chain.from_iterable(t.encode(text)))
        return ids, len(ids)

    return _per_text(docs, make, ["ids", "n_tokens"], [pa.list_(pa.int32()), pa.int64()], path)


def decode(encoded: DataFrame, path: str | None = None, piece: int = 1 << 14) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); ids are fed to the machine piece by piece. Null ids decode to an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        t = transducer(sent.value)
        for batch in batches:
            texts = ["".join(t.decode(v[i : i + piece] for i in range(0, len(v), piece))) for v in (x or [] for x in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return in_workers(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): round trip of every text within its task."""
    names, kinds = ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()]
    return _per_text(docs, lambda t, text: t.digests(text), names, kinds, path)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): ``digests`` with the ids themselves."""

    def make(t, text):
        kept: list[np.ndarray] = []
        return *t.digests(text, kept), np.concatenate(kept) if kept else np.zeros(0, np.int32)

    names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    return _per_text(docs, make, names, [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())], path)


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"))
