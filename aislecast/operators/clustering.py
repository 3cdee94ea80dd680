"""Clustering of entity tables: k-means, choice of k, density clusters, quality, profiles, assignment."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import ladder, ratio
from ..session import ensure_checkpoint_dir, written
from . import density
from .forecast import cached
from .ranking import with_group_place

SEED = 42


def held_once(entities: DataFrame) -> DataFrame:
    """An entity table checkpointed in the shared folder: selection, fit and output read it instead of the facts."""
    ensure_checkpoint_dir(entities.sparkSession)
    return entities.checkpoint()


def fill_gaps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL and NaN become 0, all columns double."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns})


def select_features(df: DataFrame, columns: Sequence[str], limit: float = 0.95) -> list[str]:
    """Columns that vary, without the later one of any pair with |r| above ``limit`` (a small matrix is read back)."""
    filled = fill_gaps(df, columns)
    spread = filled.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first().asDict()
    kept = [c for c in columns if (spread[c] or 0.0) > 1e-12]
    vec = VectorAssembler(inputCols=kept, outputCol="v").transform(filled).select("v")
    r = Correlation.corr(vec, "v").first()[0].toArray()
    drop = {kept[j] for i in range(len(kept)) for j in range(i + 1, len(kept)) if abs(r[i, j]) > limit}
    return [c for c in kept if c not in drop]


def _scaled(columns: Sequence[str]) -> list:
    return [
        VectorAssembler(inputCols=list(columns), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]


def standardised(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The columns as the clusterings see them: gaps 0, mean 0 and deviation 1 (a constant column 0)."""
    filled = fill_gaps(df, columns)
    out = vector_to_array(F.col("features"))
    scaled = Pipeline(stages=_scaled(columns)).fit(filled).transform(filled)
    return scaled.select(key, *[out[i].alias(c) for i, c in enumerate(columns)])


def kmeans_clusters(df: DataFrame, columns: Sequence[str], k: int, seed: int = SEED, components: int | None = None) -> DataFrame:
    """Rows with standardised ``features``, ``cluster`` and squared ``distance`` to the centre; optionally on main components."""
    filled = fill_gaps(df, columns)
    stages = _scaled(columns)
    space = "features"
    if components is not None:
        stages.append(PCA(k=min(components, len(columns)), inputCol="features", outputCol="components"))
        space = "components"
    stages.append(KMeans(k=k, seed=seed, featuresCol=space, predictionCol="cluster"))
    with cached(filled) as held:
        model = Pipeline(stages=stages).fit(held)
    centres = [c.tolist() for c in model.stages[-1].clusterCenters()]
    out = model.transform(filled).drop("_raw")
    centre = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres]), F.col("cluster") + 1)
    point = vector_to_array(space)
    sq = F.aggregate(F.zip_with(point, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return out.withColumn("distance", sq)


def choose_k(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(2, 11), seed: int = SEED) -> DataFrame:
    """Silhouette (squared Euclidean) and inertia for each k; the best silhouette and the elbow are marked."""
    filled = fill_gaps(df, columns)
    scaled = Pipeline(stages=_scaled(columns)).fit(filled).transform(filled).select("features")
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster", metricName="silhouette")
    rows = []
    with cached(scaled) as held:
        for k in ks:
            model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(held)
            rows.append((int(k), float(judge.evaluate(model.transform(held))), float(model.summary.trainingCost)))
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    bend = {rows[i][0]: rows[i - 1][2] - 2 * rows[i][2] + rows[i + 1][2] for i in range(1, len(rows) - 1)}
    elbow = max(bend, key=lambda k: (bend[k], -k)) if bend else best
    data = [(k, s, c, k == best, k == elbow) for k, s, c in rows]
    return df.sparkSession.createDataFrame(data, "k int, silhouette double, inertia double, is_best boolean, is_elbow boolean")


# ---- quality and profiles ---------------------------------------------------------------------


def cluster_quality(clustered: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Clusters, rows, inertia and Calinski-Harabasz index in the given columns, by two aggregations.

    Noise (cluster -1) is left out.
    """
    kept = clustered.filter(F.col(cluster) >= 0)
    long = kept.select(cluster, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([cluster], list(columns), "f", "x")
    part = long.groupBy(cluster, "f").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    total = long.groupBy("f").agg(F.avg("x").alias("tm"))
    j = part.join(total, "f")
    g = j.agg(
        F.count_distinct(cluster).alias("clusters"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * (F.col("m") - F.col("tm")) * (F.col("m") - F.col("tm"))).alias("between"),
        (F.sum("n") / len(columns)).cast("bigint").alias("rows"),
    )
    k, n = F.col("clusters"), F.col("rows")
    ch = F.try_divide(F.col("between") / (k - 1), F.col("within") / (n - k))
    return g.select("clusters", "rows", F.col("within").alias("inertia"), F.when(k > 1, ch).alias("calinski_harabasz"))


def cluster_sizes(clustered: DataFrame, cluster: str = "cluster") -> DataFrame:
    g = clustered.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    n = g.agg(F.sum("size")).scalar()
    return g.withColumn("share", ratio("size", n))


def cluster_profiles(clustered: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Per cluster and feature: mean, deviation, range, z-score of the mean, place by |z| and between/within importance."""
    long = clustered.select(cluster, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([cluster], list(columns), "feature", "x")
    g = long.groupBy(cluster, "feature").agg(
        F.count(F.lit(1)).alias("size"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.var_pop("x").alias("_v")
    )
    t = long.groupBy("feature").agg(F.avg("x").alias("_tm"), F.stddev_pop("x").alias("_ts"))
    j = g.join(t, "feature").withColumn("z_score", F.try_divide(F.col("mean") - F.col("_tm"), F.col("_ts")))
    w = W.partitionBy("feature")
    between = F.sum(F.col("size") * (F.col("mean") - F.col("_tm")) * (F.col("mean") - F.col("_tm"))).over(w)
    within = F.sum(F.col("size") * F.col("_v")).over(w)
    place = F.row_number().over(W.partitionBy(cluster).orderBy(F.abs("z_score").desc_nulls_last(), "feature"))
    return j.withColumns({"importance": F.try_divide(between, within), "place": place}).drop("_v", "_tm", "_ts")


def cluster_names(profiles: DataFrame, level: str, cluster: str = "cluster") -> DataFrame:
    """Name by the z-score of a level feature, with the most telling feature."""
    g = profiles.groupBy(cluster).agg(
        F.max("size").alias("size"),
        F.max(F.when(F.col("feature") == level, F.col("z_score"))).alias("level_z"),
        F.max(F.when(F.col("place") == 1, F.col("feature"))).alias("main_feature"),
        F.max(F.when(F.col("place") == 1, F.col("z_score"))).alias("main_z"),
    )
    name = ladder("level_z", [(0.75, "High"), (0.25, "Above average"), (-0.25, "Average"), (-0.75, "Below average")], "Low")
    return g.withColumn("name", name)


def cluster_insights(names: DataFrame) -> DataFrame:
    """Advice class per cluster from its level and size."""
    n = names.agg(F.sum("size")).scalar()
    share = ratio("size", n)
    z = F.col("level_z")
    return names.withColumns(
        {
            "share": share,
            "advice": F.when(z >= 0.75, "protect").when(z >= 0.25, "grow").when(z >= -0.25, "maintain").when(share < 0.1, "review").otherwise("improve"),
            "priority": F.when(F.abs(z) >= 0.75, "high").when(F.abs(z) >= 0.25, "medium").otherwise("low"),
        }
    )


def similarity(clustered: DataFrame, key: str) -> DataFrame:
    """Closeness 1/(1+distance) of every row to its centre and its place within the cluster."""
    placed = with_group_place(clustered.select(key, "cluster", "distance"), ["cluster"], "distance", key)
    return placed.select(key, "cluster", (1 / (1 + F.sqrt("distance"))).alias("similarity"), "place")


def representatives(clustered: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The ``k`` rows nearest to each centre: first within 64 slices of each cluster, then among those winners."""
    parts = 64
    near = W.partitionBy("cluster", "_p").orderBy("distance", key)
    first = clustered.withColumn("_p", F.pmod(F.xxhash64(key), F.lit(parts))).withColumn("_r", F.row_number().over(near))
    top = first.filter(F.col("_r") <= k)
    final = W.partitionBy("cluster").orderBy("distance", key)
    return top.withColumn("place", F.row_number().over(final)).filter(F.col("place") <= k).select("cluster", "place", key, "distance")


def with_unseen(entities: DataFrame, clustered: DataFrame, key: str) -> DataFrame:
    """Every entity with its cluster; one without a cluster gets the most frequent."""
    modal = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("cluster", F.struct("n", -F.col("cluster")))).scalar()
    return entities.select(key).join(clustered.select(key, "cluster"), key, "left").withColumns(
        {"is_assigned": F.col("cluster").isNull(), "cluster": F.coalesce("cluster", modal)}
    )


def dominant_clusters(clustered: DataFrame, group: str) -> DataFrame:
    """Most frequent cluster of each group and its share."""
    g = clustered.groupBy(group, "cluster").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy(group).agg(
        F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("dominant_cluster"),
        F.sum("n").alias("members"),
        ratio(F.max("n"), F.sum("n")).alias("share"),
    )


def performance_bands(clustered: DataFrame, value: str) -> DataFrame:
    """Clusters by mean of a value, best first, with a band by place."""
    g = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.avg(F.col(value).cast("double")).alias("mean_value"))
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("mean_value"), "cluster")  # one row per cluster
    n = g.agg(F.count(F.lit(1))).scalar()
    out = g.withColumn("place", F.row_number().over(w))
    p = F.col("place") / n
    return out.withColumn("band", F.when(p <= 1 / 3, "high").when(p <= 2 / 3, "medium").otherwise("low"))


# ---- density clusters -------------------------------------------------------------------------


def _density_points(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    filled = fill_gaps(df, columns)
    scaled = Pipeline(stages=_scaled(columns)).fit(filled).transform(filled)
    return scaled.select(F.col(key).cast("bigint").alias("id"), vector_to_array("features").alias("x"))


def _density_parameters(points: DataFrame, vectors: DataFrame, dims: int, eps: float | None, min_samples: int | None, block: int) -> tuple[float, int]:
    min_samples = max(3, dims + 1) if min_samples is None else min_samples
    if eps is None:
        eps = density.default_radius(points, vectors, dims, max(1, min(4, points.count() - 1) - 1), block)
    return float(eps), min_samples


def density_clusters(
    df: DataFrame, key: str, columns: Sequence[str], eps: float | None = None, min_samples: int | None = None, block: int = density.BLOCK
) -> DataFrame:
    """Density clusters (noise = -1, otherwise the smallest core id of the cluster) of standardised rows.

    Neighbours are found through a grid of cells and core cells are united by label propagation with pointer jumping,
    each round written to the shared folder.  Without ``eps`` it is the upper quartile of the distance to the fourth
    nearest point, the point itself being the first (or to the farthest of fewer points); ``min_samples`` is the
    dimension plus 1, at least 3.  A border point takes the least of the clusters it reaches.
    """
    points, vectors = density.prepared(_density_points(df, key, columns))
    radius, least = _density_parameters(points, vectors, len(columns), eps, min_samples, block)
    found = density.labels(vectors, radius, len(columns), least, block, connected_labels)
    return points.join(found.drop("u"), "x").select(F.col("id").alias(key), "cluster", F.col("core").alias("is_core"))


def density_core(
    df: DataFrame, key: str, columns: Sequence[str], eps: float | None = None, min_samples: int | None = None, block: int = density.BLOCK
) -> tuple[DataFrame, float]:
    """(id, x, n, core) with the number of points within the radius, itself included, and the radius."""
    points, vectors = density.prepared(_density_points(df, key, columns))
    radius, least = _density_parameters(points, vectors, len(columns), eps, min_samples, block)
    counts = vectors.join(density.neighbour_counts(vectors, radius, len(columns), block), "u").select("x", "n")
    return points.join(counts, "x").select("id", "x", "n", (F.col("n") >= least).alias("core")).checkpoint(), radius


def connected_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest node id of each connected component; every round halves the remaining chains and is written to the shared folder."""
    both = written(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = written(nodes.withColumn("label", F.col("id")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        step = written(step.join(jump, "new", "left").select("id", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        changed = step.filter(F.col("new") != F.col("label")).limit(1).count()
        labels = step.select("id", F.col("new").alias("label"))
        if not changed:
            return labels


def principal_components(df: DataFrame, key: str, columns: Sequence[str], k: int = 20) -> DataFrame:
    """Scores on the first ``k`` main components as an array, with the variance they explain."""
    filled = fill_gaps(df, columns)
    k = min(k, len(columns))
    model = Pipeline(stages=[*_scaled(columns), PCA(k=k, inputCol="features", outputCol="components")]).fit(filled)
    explained = float(sum(model.stages[-1].explainedVariance.toArray()))
    scores = vector_to_array("components")
    out = model.transform(filled)
    return out.select(key, *[scores[i].alias(f"pc_{i + 1}") for i in range(k)], F.lit(explained).alias("explained_variance"))

