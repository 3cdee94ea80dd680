"""Near duplicates of embeddings: PCA-ordered tiles, compared leading dimensions first.

Equal vectors are one. Vectors are turned into the axes of their second moments (a rotation, so products stay), put in
the order of the first axis within their label and cut into tiles of at most ``TILE`` vectors. Two tiles whose boxes on the
leading axes are too far apart hold no link; other pairs of tiles are tasks. A task adds up products block by block of
dimensions and bounds what is left by the norms of the remaining parts: pairs that cannot reach the threshold any more
are given up, and the tile pair as soon as none is left. A task returns link counts and a spanning forest, never pairs,
so a group of thousands of near copies costs as much output as it has members.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those without label or id,
link with nothing and are kept; only vectors of one length are compared; rows of one id are vectors of their own
(their component id is the smallest id reachable); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, in_workers, running_total, stored, table

THRESHOLD, TILE, BLOCK, BOX = 0.93, 2048, 16, 4
SLACK = 1e-9  # rounding of rotated products; pairs this close to the threshold are decided on the vectors themselves


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """Rotation to principal axes for each vector length, from all vectors; one small matrix per length and slot is gathered."""

    def moments(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size in set(batch.column(1).to_pylist()):
                x = _matrix(batch.column(0).filter(pa.compute.equal(batch.column(1), size)))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                total[size] = total.get(size, 0) + x.T @ x
        if total:
            rows = [(s, m.tobytes()) for s, m in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["size", "m"])

    def add(key, group):
        m = np.sum([np.frombuffer(b.as_py()) for b in group.column("m")], axis=0)
        return pa.table({"size": pa.array([key[0].as_py()], pa.int32()), "m": pa.array([m.tobytes()], pa.binary())})

    parts = in_workers(reps.select("embedding", "size"), moments, "size int, m binary")
    slots = parts.groupBy("size", F.pmod(F.spark_partition_id(), F.lit(16)).alias("slot"))
    out: dict[int, np.ndarray] = {}
    for r in sorted(slots.applyInArrow(add, "size int, m binary").collect()):
        out[r["size"]] = out.get(r["size"], 0) + np.frombuffer(r.m)
    return {s: np.linalg.eigh(m.reshape(s, s))[1][:, ::-1].copy() for s, m in out.items()}


def _linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows of two rotated unit matrices may have a product of at least ``threshold`` (less SLACK), as (i, j, product)."""
    dims = a.shape[1]
    rest_a = np.sqrt(np.maximum(0, np.cumsum((a * a)[:, ::-1], axis=1)[:, ::-1]))
    rest_b = np.sqrt(np.maximum(0, np.cumsum((b * b)[:, ::-1], axis=1)[:, ::-1]))
    done = min(BLOCK, dims)
    total = a[:, :done] @ b[:, :done].T
    while done < dims:
        alive = total + np.outer(rest_a[:, done], rest_b[:, done]) >= threshold - SLACK
        n = np.count_nonzero(alive)
        if not n:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        if n * 8 < alive.size:  # few are left: go on with these alone
            i, j = np.nonzero(alive)
            s = total[i, j]
            while done < dims and len(i):
                more = min(dims, done + BLOCK)
                s = s + np.einsum("ij,ij->i", a[i, done:more], b[j, done:more])
                done = more
                rest = rest_a[i, done] * rest_b[j, done] if done < dims else 0.0
                live = s + rest >= threshold - SLACK
                i, j, s = i[live], j[live], s[live]
            return i, j, s
        more = min(dims, done + BLOCK)
        total += a[:, done:more] @ b[:, done:more].T
        done = more
    i, j = np.nonzero(total >= threshold - SLACK)
    return i, j, total[i, j]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes over the links (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if np.array_equal(low, root):
            return root
        root = low


def _compare(turn: dict[int, np.ndarray], threshold: float):
    def kernel(key, group):
        first, second = key[-2].as_py(), key[-1].as_py()
        side = group.column("side").to_numpy()
        node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        plain = _matrix(group.column("embedding"))
        length = np.linalg.norm(plain, axis=1)
        unit = (plain / length[:, None]) @ turn[plain.shape[1]]
        left = np.flatnonzero(side == 0)
        right = left if first == second else np.flatnonzero(side == 1)
        i, j, s = _linked(unit[left], unit[right], threshold)
        i, j = left[i], right[j]
        if first == second:
            keep = i < j
            i, j, s = i[keep], j[keep], s[keep]
        near = np.flatnonzero(np.abs(s - threshold) <= SLACK)
        if len(near):
            exact = np.einsum("ij,ij->i", plain[i[near]], plain[j[near]]) / (length[i[near]] * length[j[near]])
            keep = np.ones(len(s), bool)
            keep[near] = exact >= threshold
            i, j = i[keep], j[keep]
        count = np.zeros(len(node), np.int64)
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        root = _forest(len(node), i, j)
        at, edge = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(node)))
        return pa.table(
            {
                "a": pa.array(np.concatenate((node[at], node[edge])), pa.int64()),
                "b": pa.array([*[None] * len(at), *node[root[edge]].tolist()], pa.int64()),
                "n": pa.array([*count[at].tolist(), *[None] * len(edge)], pa.int64()),
            }
        )

    return kernel


def _scaled() -> Column:
    """The vector in double precision, very small and very large ones times a power of two: no norm under- or overflows."""
    e = F.col("embedding").cast("array<double>")
    most = F.array_max(F.transform(e, F.abs))
    power = F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), -F.floor(F.log2(most)).cast("double")))
    return F.when(most.between(1e-100, 1e100), e).otherwise(F.coalesce(F.transform(e, lambda x: x * F.pow(F.lit(2.0), power)), e))


def _valid(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    infinite = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(e) > 0) & ~infinite & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), _scaled().alias("embedding"), ok.alias("ok")).where("ok").drop("ok")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    rows = _valid(vectors).withColumn("hash", F.xxhash64("embedding"))
    reps = rows.groupBy("label", "hash", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    reps = stored(reps.withColumn("size", F.size("embedding")).withColumn("node", F.xxhash64("first", "label", "embedding")), "vectors")
    turn = axes(reps)

    def project(batches):
        for batch in batches:
            lead = np.zeros((batch.num_rows, BOX))
            size = batch.column(batch.schema.get_field_index("size")).to_numpy()
            for s in set(size.tolist()):
                at = np.flatnonzero(size == s)
                x = _matrix(batch.column(batch.schema.get_field_index("embedding")).take(pa.array(at)))
                p = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn[s][:, :BOX]
                lead[np.ix_(at, np.arange(p.shape[1]))] = p
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(lead[:, k]) for k in range(BOX))], [*batch.schema.names, *LEAD])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema.fields)
    placed = in_workers(reps, project, kind + "".join(f", {c} double" for c in LEAD))
    cell = F.greatest(F.lit(0), F.least(F.lit(65535), F.floor((F.col("p0") + 1) * 32768))).cast("int")
    placed = placed.withColumns({"b1": F.floor(cell / 256).cast("int"), "b2": cell, "b3": F.pmod("node", F.lit(64)).cast("int"), "one": F.lit(1).cast("long")})
    ranked = running_total(placed, ["label", "size"], ["b1", "b2", "b3"], [F.col("node")], "one", "rank")
    tiled = stored(ranked.select("label", "size", "node", "copies", "embedding", *LEAD, F.floor(F.col("rank") / tile).cast("long").alias("tile")), "tiles")

    box = [f(c).alias(f"{n}_{c}") for c in LEAD for f, n in ((F.min, "low"), (F.max, "high"))]
    boxes = stored(tiled.groupBy("label", "size", "tile").agg(*box), "boxes")  # one row per tile
    other = boxes.select("label", "size", F.col("tile").alias("second"), *[F.col(c).alias(f"o_{c}") for c in boxes.columns[3:]])
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"low_{c}") - F.col(f"o_high_{c}"), F.col(f"o_low_{c}") - F.col(f"high_{c}")), 2) for c in LEAD), F.lit(0.0))
    met = boxes.join(other, ["label", "size"]).where((F.col("tile") <= F.col("second")) & (gap <= 2 - 2 * threshold + SLACK))
    met = stored(met.select("label", "size", F.col("tile").alias("first"), "second"), "met")
    sides = met.select("label", "size", F.col("first").alias("tile"), "first", "second", F.lit(0).alias("side")).union(
        met.where("first < second").select("label", "size", F.col("second").alias("tile"), "first", "second", F.lit(1).alias("side"))
    )
    work = sides.join(tiled.select("label", "size", "tile", "node", "copies", "embedding"), ["label", "size", "tile"])
    found = stored(work.groupBy("label", "size", "first", "second").applyInArrow(_compare(turn, threshold), "a long, b long, n long"), "links")

    counts = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    roots = components(found.where("b is not null").select("a", "b"))
    base = reps.select("node", "first", "copies", "label", "hash", "embedding").join(counts, "node", "left").join(roots, "node", "left")
    base = base.withColumn("root", F.coalesce("root", "node"))
    least = base.groupBy("root").agg(F.min("first").alias("component_id"))
    known = base.join(least, "root").select("label", "hash", "embedding", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    known = stored(known.withColumnsRenamed({"label": "of", "hash": "of_hash", "embedding": "of_embedding"}), "known")
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", _scaled().alias("embedding"))
    every = every.withColumn("hash", F.when(F.col("vec_id").isNotNull(), F.xxhash64("embedding")))
    on = (F.col("label") == F.col("of")) & (F.col("hash") == F.col("of_hash")) & (F.col("embedding") == F.col("of_embedding"))
    out = every.join(known, on, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


LEAD = [f"p{k}" for k in range(BOX)]


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT c.a AS vec_id, (SELECT count(*) FROM l WHERE l.a = c.a) AS n_links, component_id, c.a = component_id AS kept FROM c
"""
