"""Hierarchical packing of token documents into windows of several context sizes.

A document longer than the largest context gives whole windows; what remains is routed to the smallest context that holds it.
Tiers are packed from the largest context down. A piece of the tier opens a window; the gaps of all its windows, one after the other, are
filled with the pieces of the shorter tiers, the shortest tiers first, one after the other: a piece that meets the end of a gap
is cut there and goes on in the next. Pieces that no gap has used stay for the tiers below, and the smallest tier is filled without
gaps. Where shorter pieces cannot fill all gaps, fewer windows are opened and the other pieces fill. So all windows are full but
the last one, which alone is padded.

Everything is running totals of lengths and gaps by hash ranges, and a merge of the two inside blocks of ``BLOCK`` tokens: neither a length,
nor a group of equal documents, nor a tier passes through one task. The driver gets two sums for each tier.

``step`` deals the windows, all contexts in order, to as many groups as the padded tokens fill ``step_tokens``: groups differ by at most
one window of each context.

Defined results: a null or empty text is the end token alone; rows of one id are documents of their own, equal rows are
interchangeable; a null id is a document without an id; strings of added tokens in a text are those tokens; an empty table
gives an empty result; only doc_id and text are read. The vocabulary file's path is a parameter.
"""

from __future__ import annotations

import hashlib
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_letters
from .common import held, in_workers, running_total, stored, table

VOCABULARY = "word_bpe_49k.json"
CONTEXTS, END, STEP_TOKENS, BLOCK = (2048, 1024, 512, 256), 1, 1 << 17, 1 << 14
# fixed value: the split pattern of the vocabulary file
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")  # characters that stay as they are but for their case


class Kept(dict):
    """Values of ``make`` by text, made when first asked for; it starts anew beyond ``limit``. Texts over 64 characters are not kept."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, text: str):
        value = self.make(text)
        if len(text) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[text] = value
        return value


class Encoder:
    """Token ids of whole texts. Texts are cut at ASCII blanks, which the vocabulary drops; each distinct word is encoded once.

    Words of letters up to U+024F go to the merge model piece by piece; others, and words that may hold an added token or a
    control character, go through the library as they are. Texts without a ``<|`` are cut before marks that follow a letter too,
    where a piece ends in any case, and lose the case of A-Z, as they do in the library.
    """

    def __init__(self, vocabulary: bytes, limit: int = 600_000):
        self.library = Tokenizer.from_buffer(vocabulary)
        self.model = self.library.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.pieces = Kept(self._piece, limit // 8)
        self.words = Kept(self._word, limit)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isalpha() and word.isascii():
            return self._piece(word.lower())
        if PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(word.lower())))
        return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def batch(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with ``end``; the place where each text begins, and the end of the last)."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,;:!?])", r"\1 \2")
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten().dictionary_encode()
        blobs = list(map(self.words.__getitem__, flat.dictionary.to_pylist()))
        size = np.fromiter(map(len, blobs), np.int32, len(blobs)) >> 2
        pool, first = np.frombuffer(b"".join(blobs), np.uint32), np.cumsum(size, dtype=np.int64) - size
        which = flat.indices.to_numpy(zero_copy_only=False)
        n = size[which]
        upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        places = np.repeat(first[which] - upto[:-1], n)
        places += np.arange(upto[-1])
        offsets = split.offsets.to_numpy()
        ends = upto[offsets - offsets[0]]
        return np.insert(pool[places], ends[1:], end).astype("<u4", copy=False), ends + np.arange(len(ends))


def read_vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file: a few MB whatever the corpus is, sent to the workers once."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


def tokens(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, part, nth, n, ids) of every row: ``ids`` are unsigned 32-bit little-endian, (part, nth) names the row."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = held(("packing", hashlib.sha256(sent.value).digest()), lambda: Encoder(sent.value))
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, at = encoder.batch(batch.column(1), end)
            k = len(batch)
            blob = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids)])
            columns = [batch.column(0), pa.array(np.full(k, part, np.int64)), pa.array(np.arange(nth, nth + k)), pa.array(np.diff(at)), blob]
            nth += k
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "nth", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return in_workers(rows, run, "doc_id long, part long, nth long, n long, ids binary")


def _filled(gaps: DataFrame, pieces: DataFrame, total: int) -> DataFrame:
    """Parts of ``pieces`` in ``gaps``: both lie end to end from ``pos`` 0 on; what they share of [0, total) is a part.

    In a block of positions each start of a piece or gap begins a part of the piece and the gap that hold there.
    """

    def starts(df, size, kind, other):
        end = F.least(F.col("pos") + F.col(size), F.lit(total)) - 1
        blocks = df.where((F.col(size) > 0) & (F.col("pos") < total)).select("*", F.explode(F.sequence(F.expr(f"pos div {BLOCK}"), F.floor(end / BLOCK))).alias("block"))
        return blocks.select("block", F.greatest("pos", F.col("block") * BLOCK).alias("at"), kind, other)

    gap = F.struct("pos", "sequence_id", F.col("length").alias("offset")).alias("gap")
    piece = F.struct("pos", "part", "nth", "start").alias("piece")
    points = starts(gaps, "gap", gap, F.lit(None).alias("piece")).unionByName(starts(pieces, "length", F.lit(None).alias("gap"), piece))
    by = Window.partitionBy("block").orderBy("at")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    after = F.coalesce(F.lead("at").over(by), F.least((F.col("block") + 1) * BLOCK, F.lit(total)))
    found = points.select("at", after.alias("end"), F.last("gap", True).over(upto).alias("g"), F.last("piece", True).over(upto).alias("p")).where("end > at")
    start, offset = F.col("p.start") + F.col("at") - F.col("p.pos"), F.col("g.offset") + F.col("at") - F.col("g.pos")
    return found.select("p.part", "p.nth", start.alias("start"), (F.col("end") - F.col("at")).alias("length"), F.col("g.sequence_id").alias("sequence_id"), offset.alias("offset"))


def place(pieces: DataFrame, contexts: tuple[int, ...], first: int) -> tuple[DataFrame, int, int]:
    """The parts of ``pieces`` (part, nth, start, length and the order's columns) in windows numbered from ``first`` on.

    Returns (part, nth, start, length, sequence_id, offset, context), the number of windows and their padded tokens.
    """
    window, order = contexts[0], [F.col(c) for c in ("place", "digest", "part", "nth")]
    long = lambda v: F.lit(v).cast("long")
    parts, number, padded, left, short = [], first, 0, pieces, False
    for context, below in zip(contexts, [*contexts[1:], 0]):
        total, opening = left.agg(F.coalesce(F.sum("length"), long(0)), F.count(F.when(F.col("length") > below, 1))).first()
        if short or total < context:  # less than a window is left
            context, below = contexts[-1], 0
        if not below:
            line = running_total(left, [], ["b"], order, "length", "pos")
            each = line.select("*", F.explode(F.sequence(F.expr(f"pos div {context}"), F.expr(f"(pos + length - 1) div {context}"))).alias("w"))
            since, until = F.greatest("pos", F.col("w") * context), F.least(F.col("pos") + F.col("length"), (F.col("w") + 1) * context)
            rest = total % context
            of = F.when(F.col("w") < total // context, long(context)).otherwise(long(rest if rest & (rest - 1) == 0 else window))
            parts.append(each.select("part", "nth", (F.col("start") + since - F.col("pos")).alias("start"), (until - since).alias("length"),
                                     (F.col("w") + number).alias("sequence_id"), (since - F.col("w") * context).alias("offset"), of.alias("context")))
            padded += total - rest + (rest if rest & (rest - 1) == 0 else window)
            number += -(-total // context)
            break
        many = min(opening, total // context)
        short = many < opening
        if not many:
            continue
        long_ones = running_total(left.where(F.col("length") > below), [], ["b"], order, "one", "rank")
        opened = long_ones.where(F.col("rank") < many).withColumns({"gap": context - F.col("length"), "sequence_id": F.col("rank") + number})
        gaps = stored(running_total(opened, [], ["b"], order, "gap", "pos"), "gaps")
        free = gaps.agg(F.sum("gap")).first()[0]
        others = left.where(F.col("length") <= below).unionByName(long_ones.where(F.col("rank") >= many).drop("rank"))
        tier = F.size(F.filter(F.array(*[long(c) for c in contexts]), lambda c: c < F.col("length")))
        line = stored(running_total(others.withColumn("tier", tier), [], ["tier", "b"], order, "length", "pos").drop("tier"), "line")
        own = gaps.select("part", "nth", "start", "length", "sequence_id", long(0).alias("offset"))
        parts.append(stored(own.unionByName(_filled(gaps, line, free)).withColumn("context", long(context)), "parts"))
        used = F.greatest(free - F.col("pos"), long(0))
        left = line.where(F.col("pos") + F.col("length") > free).withColumns({"start": F.col("start") + used, "length": F.col("length") - used}).drop("pos")
        number, padded = number + many, padded + many * context
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, number - first, padded


def pack(docs: DataFrame, contexts: tuple[int, ...] = CONTEXTS, path: str | None = None, end: int = END, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset, context, step) of every piece; ``ids`` are its tokens."""
    return _pieces(docs, contexts, path, end, step_tokens, lambda ids: ids)


def _pieces(docs, contexts, path, end, step_tokens, of_ids) -> DataFrame:
    contexts = tuple(sorted(contexts, reverse=True))
    window = contexts[0]
    encoded = stored(tokens(docs, path, end), "tokens")
    hashed = F.md5(F.concat_ws(":", F.lit("d"), "doc_id").cast("binary"))
    full = F.expr(f"n div {window}")
    lean = encoded.select(
        "part", "nth", full.alias("full"), (full * window).alias("start"), F.expr(f"n % {window}").alias("length"), hashed.alias("place"), F.crc32("ids").alias("digest"),
        F.substring(hashed, 1, 4).alias("b"), F.lit(1).cast("long").alias("one"),
    )
    lean = stored(lean, "lean")
    whole = lean.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    parts, windows, padded = place(lean.where("length > 0").drop("full"), contexts, whole)
    steps = max(1, -(-(whole * window + padded) // step_tokens))
    order = [F.col(c) for c in ("place", "digest", "part", "nth")]
    before = running_total(lean.where("full > 0"), [], ["b"], order, "full", "before").select("part", "nth", "full", "before")
    per = parts.groupBy("part", "nth").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset", "context")).alias("pieces"))
    placed = per.join(before, ["part", "nth"], "full")
    long = lambda v: F.lit(v).cast("long")
    cut = F.transform(
        F.when(F.col("full") > 0, F.sequence(long(0), F.col("full") - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda i: F.struct((i * window).alias("start"), long(window).alias("length"), (F.col("before") + i).alias("sequence_id"), long(0).alias("offset"), long(window).alias("context")),
    )
    none = F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint,context:bigint>>")
    found = encoded.join(placed.select("part", "nth", F.concat(cut, F.coalesce("pieces", none)).alias("pieces")), ["part", "nth"])
    ids = lambda p: of_ids(F.substring("ids", (4 * p["start"] + 1).cast("int"), (4 * p["length"]).cast("int")))
    out = found.select("doc_id", F.col("n").alias("doc_tokens"), F.inline(F.transform("pieces", lambda p: p.withField("ids", ids(p)))))
    return out.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "context", F.pmod("sequence_id", F.lit(steps)).alias("step"))


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = _pieces(table(spark, folder, "documents"), CONTEXTS, None, END, STEP_TOKENS, F.crc32)
    return pieces.withColumnRenamed("ids", "ids_crc32")
