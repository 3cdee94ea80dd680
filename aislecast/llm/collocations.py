"""Phrase collocations: word sequences that occur more often than their parts foretell.

Texts are taken in chunks; a chunk is a sequence of numbers (0 ends a piece), packed, and a dictionary, so each distinct word leaves a
task once per chunk. Words of at least ``least`` occurrences are numbered by falling frequency, pairs of neighbouring numbers
are counted in tiles of ``TILE`` x ``TILE``: tiles that a chunk fills well by direct address (``bincount``), the others as sorted
coordinates. Pairs that are frequent over all chunks are numbered by falling frequency in turn and replace the words, so that
the next round counts overlapping pairs of pairs: phrases of three words, then of four, then of five. A phrase has only
frequent parts, so nothing is missed by going on with frequent ones alone.

No vocabulary is sent to all tasks: a chunk gets the numbers of its own words (pairs) back through a join. Sums over chunks, numbers
and scores are DataFrame work; a key has at most one row a chunk however often it occurs.

Defined results: a null text is empty, a null lang is ``und``; blanks end words and ``.,;:!?`` or a line end ends a piece, so do texts;
rows count as often as they are there, with or without an id; products are decimals of 38 digits, the division is exact;
an empty table, or no phrase of ``least`` occurrences, gives an empty result; columns other than lang and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_workers, running_total, stored, table
from .ngrams import _packed, _unpacked

ENDS = "[.,;:!?\n-\r]+"
TILE, DENSE = 1024, 1 << 16  # a tile with so many occurrences in a chunk is counted by direct address
CHUNK = 16 << 20  # bytes of text
LOW = (1 << 32) - 1


def numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, their counts, the texts as numbers from 1): 0 stands for the end of a piece or text."""
    marked = pc.replace_substring_regex(pc.ascii_lower(texts), ENDS, " . ")
    split = pc.ascii_split_whitespace(marked)
    words = split.flatten().dictionary_encode()
    numbers = words.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
    counts = np.bincount(numbers, minlength=len(words.dictionary) + 1)[1:]
    for mark in ("", "."):
        at = words.dictionary.index(mark).as_py()
        if at >= 0:
            numbers[numbers == at + 1] = 0
            counts[at] = 0
    return words.dictionary, counts, np.insert(numbers, split.offsets.to_numpy()[1:-1], 0)


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(lang, chunk, n, words, counts, seq): texts of one language and task, up to ``size`` bytes (or one longer text) each."""
    schema = "lang string, chunk long, n long, words array<string>, counts array<long>, seq binary"

    def run(batches):
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}
        made = TaskContext.get().partitionId() << 32

        def close(lang):
            nonlocal made
            words, counts, seq = numbered(pa.concat_arrays(held.pop(lang)))
            del sizes[lang]
            there = counts > 0
            seq = np.concatenate([[0], np.cumsum(there)])[seq]  # marks have no number
            kept = words.filter(pa.array(there))
            made += 1
            columns = [[lang], [made], [int(counts.sum())], pa.ListArray.from_arrays([0, len(kept)], kept), [counts[there].tolist()], [_packed(seq.astype("<u4"))]]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["lang", "chunk", "n", "words", "counts", "seq"])

        for batch in batches:
            for lang in batch.column(0).unique().to_pylist():
                texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
                held.setdefault(lang, []).append(texts)
                sizes[lang] = sizes.get(lang, 0) + texts.nbytes
                if sizes[lang] >= size:
                    yield close(lang)
            while sum(sizes.values()) >= 2 * size:
                yield close(max(sizes, key=sizes.get))
        for lang in list(held):
            yield close(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return in_workers(rows, run, schema)


def tile_counts(left: np.ndarray, right: np.ndarray, dense: int = DENSE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, counts) of pairs of numbers from 1: tiles with ``dense`` pairs or more by direct address, the rest as sorted coordinates."""
    row, column = (left - 1) // TILE, (right - 1) // TILE
    tiles, which, sizes = np.unique(row << 32 | column, return_inverse=True, return_counts=True)
    full = np.flatnonzero(sizes >= dense)
    for t in full:
        here = which == t
        top, first = (int(tiles[t]) >> 32) * TILE + 1, (int(tiles[t]) & LOW) * TILE + 1
        cells = np.bincount((left[here] - top) * TILE + right[here] - first, minlength=TILE * TILE)
        found = np.flatnonzero(cells)
        yield (found // TILE + top) << 32 | (found % TILE + first), cells[found]
    rest = ~np.isin(which, full)
    yield np.unique(left[rest] << 32 | right[rest], return_counts=True)


def pairs(seqs: DataFrame) -> DataFrame:
    """(lang, chunk, key, n): each chunk's distinct pairs of neighbouring numbers and how often it has them."""

    def run(batches):
        for batch in batches:
            for lang, chunk, seq in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = _unpacked(seq).astype(np.int64)
                both = (s[:-1] > 0) & (s[1:] > 0)
                for codes, counts in tile_counts(s[:-1][both], s[1:][both]):
                    for i in range(0, len(codes), 1 << 16):
                        part = [pa.array(codes[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)].astype(np.int64))]
                        same = [pa.repeat(pa.scalar(v, k), len(part[0])) for v, k in ((lang, pa.string()), (chunk, pa.int64()))]
                        yield pa.RecordBatch.from_arrays([*same, *part], ["lang", "chunk", "key", "n"])

    return in_workers(seqs.select("lang", "chunk", "seq"), run, "lang string, chunk long, key long, n long")


def frequent(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """From (lang, chunk, key, n[, no]): the rows whose key has ``least`` occurrences or more, and (lang, key, f, id) of these keys.

    ``id`` counts from 1 by falling frequency (sixteenths of an octave, then a hash, then exactly), cumulated by these ranges.
    """
    total = F.sum("n").over(Window.partitionBy("lang", "key"))
    found = stored(rows.withColumn("f", total).where(F.col("f") >= least).drop("n"), "found")
    keys = found.groupBy("lang", "key").agg(F.max("f").alias("f")).withColumns({"one": F.lit(1).cast("long"), "b1": -F.round(16 * F.log2("f")).cast("int"), "b2": F.pmod(F.xxhash64("key"), F.lit(64))})
    ids = running_total(keys, ["lang"], ["b1", "b2"], [F.desc("f"), F.col("key")], "one", "before")
    return found, stored(ids.select("lang", "key", "f", (F.col("before") + 1).alias("id")), "keys")


def renumbered(seqs: DataFrame, found: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """(lang, chunk, seq): the chunks' sequences of words (``at`` = "no") or of pairs (``at`` = "key") as the ids of frequent ones."""
    # a key's id reaches its rows in one sorted pass over both: a key has a row a chunk, and more frequent keys with more input
    rows = found.select("lang", "key", "chunk", F.col(at).cast("long").alias("at"), F.lit(None).cast("long").alias("id"))
    both = rows.unionByName(ids.select("lang", "key", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("long").alias("at"), "id"))
    named = both.withColumn("id", F.max("id").over(Window.partitionBy("lang", "key"))).where("chunk is not null")
    own = named.groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("ids"))

    def run(batches):
        for batch in batches:
            out = []
            for seq, own in zip(batch.column(2).to_pylist(), batch.column(3)):
                s = _unpacked(seq).astype(np.int64)
                known = own.values
                places, names = (known.field(i).to_numpy() for i in (0, 1))
                by = np.argsort(places)
                places, names = places[by], names[by]
                codes = s - 1 if at == "no" else np.where((s[:-1] > 0) & (s[1:] > 0), s[:-1] << 32 | s[1:], -1)
                where = np.minimum(np.searchsorted(places, codes), len(places) - 1)
                t = np.where(places[where] == codes, names[where], 0)
                if len(t) and t.max() > np.iinfo(np.int32).max:
                    raise OverflowError("more than 2**31 frequent phrases in one language")
                ends = t == 0
                out.append(_packed(t[~(ends & np.concatenate([[False], ends[:-1]]))].astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["lang", "chunk", "seq"])

    return in_workers(seqs.select("lang", "chunk", "seq").join(own, "chunk").select("lang", "chunk", "seq", "ids"), run, "lang string, chunk long, seq binary")


def phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of all phrases of up to ``longest`` words and ``least`` occurrences, and (lang, n) of all words."""
    cut = stored(chunks(docs), "chunks")
    words = cut.select("lang", "chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("no", "w"))
    found, ids = frequent(words.select("lang", "chunk", F.col("w.words").alias("key"), F.col("w.counts").alias("n"), "no"), least)
    level = ids.select("lang", "id", "f", F.array("key").alias("words"))
    out, seqs = level, cut
    for size in range(2, longest + 1):
        seqs = stored(renumbered(seqs, found, ids, "no" if size == 2 else "key"), "seqs")
        found, ids = frequent(pairs(seqs), least)
        left = level.select("lang", F.col("id").alias("left"), F.col("words").alias("head"))
        right = level.select("lang", F.col("id").alias("right"), F.element_at("words", -1).alias("tail"))
        parts = ids.select("lang", "id", "f", F.shiftright("key", 32).alias("left"), F.col("key").bitwiseAND(F.lit(LOW)).alias("right"))
        named = parts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
        level = stored(named.select("lang", "id", "f", F.concat("head", F.array("tail")).alias("words")), "level")
        out = out.union(level)
    return out.drop("id"), cut.groupBy("lang").agg(F.sum("n").alias("n"))


def _product(*factors: Column, digits: int = 18) -> Column:
    out = factors[0].cast(f"decimal({digits},0)")
    for f in factors[1:]:
        out = out * f.cast(f"decimal({digits},0)")
    return out


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by the score of their weakest cut.

    A phrase inside a longer one that has ``share`` per cent of its occurrences is left out.
    """
    known, totals = phrases(docs, least, longest)
    known = stored(known.select("lang", F.array_join("words", " ").alias("phrase"), F.size("words").alias("size"), "words", F.col("f").alias("a")), "phrases")
    many = known.where("size > 1")
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    count = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(f))
    cuts = many.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    scored = cuts.join(count("first", "l"), ["lang", "first"]).join(count("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    scored = scored.withColumns({"above": 1000 * _product(F.col("a"), F.col("n"), digits=16), "below": _product(F.col("l"), F.col("r"))})
    scored = scored.withColumn("score", F.expr("above div below"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("w")).select("lang", "phrase", "w.*")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: part(i, m))))
    around = many.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("outer"))
    around = around.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = weakest.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("outer") < share * F.col("a"), F.lit(True)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {m}::BIGINT AS size, array_to_string(list_slice(w, i, i + {m - 1}), ' ') AS phrase, list_slice(w, i, i + {m - 1}) AS words FROM (SELECT lang, w, unnest(range(1, len(w) - {m - 2})) AS i FROM p WHERE len(w) >= {m})"
    for m in range(1, 6)
)
SQL = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
s AS (SELECT lang, unnest(string_split_regex(body, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM s),
g AS MATERIALIZED ({_GRAMS}),
f AS MATERIALIZED (SELECT lang, size, phrase, any_value(words) AS words, count(*) AS a FROM g GROUP BY lang, size, phrase HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, a, k, array_to_string(list_slice(words, 1, k), ' ') AS first, array_to_string(list_slice(words, k + 1, size), ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1)),
x AS (SELECT c.lang, c.phrase, c.k, c.a, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * c.a * n.n // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest JOIN n ON n.lang = c.lang),
m AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a, array_to_string(list_slice(words, j, j + z - 1), ' ') AS phrase
  FROM (SELECT *, unnest(range(1, size - z + 2)) AS j FROM (SELECT *, unnest(range(2, size)) AS z FROM f WHERE size > 2))),
d AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = m.lang AND i.phrase = m.phrase AND 100 * i.a >= 100 * m.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d QUALIFY rank <= 2000
"""
