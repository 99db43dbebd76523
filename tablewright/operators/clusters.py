"""Segments, principal components, density clusters and their quality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import finite, is_float, one_row
from tablewright.operators.density import components, dbscan  # noqa: F401

MAX_CLUSTERS = 2_000


def feature_matrix(df: DataFrame, features: Sequence[str], scale: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Complete rows with infinities dropped, optionally as z-scores (population deviation)."""
    clean = df.select(*keep, *[(finite(f) if is_float(df, f) else F.col(f)).cast("double").alias(f) for f in features])
    clean = clean.dropna("any", subset=list(features))
    if not scale:
        return clean
    row = one_row(clean, *[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))])
    z = {f: (F.col(f) - F.lit(row[f"m_{f}"])) / F.lit(row[f"s_{f}"] or 1.0) for f in features}
    return clean.withColumns(z)


def _vectors(matrix: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(matrix)


def kmeans_segments(matrix: DataFrame, features: Sequence[str], k: int = 3, seed: int = 0) -> DataFrame:
    """Rows with their ``cluster``; clusters are numbered by size, largest first."""
    rows = _vectors(matrix, features)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="_c", maxIter=50).fit(rows)
    sizes = sorted(zip(model.summary.clusterSizes, range(len(model.summary.clusterSizes)), strict=True), key=lambda s: (-s[0], s[1]))
    rank = F.create_map(*[x for new, (_, old) in enumerate(sizes) for x in (F.lit(old), F.lit(new))])
    return model.transform(rows).withColumn("cluster", rank[F.col("_c")].cast("long")).drop("features", "_c")


def segment_profile(clustered: DataFrame, features: Sequence[str]) -> DataFrame:
    """Size and feature means per cluster."""
    return clustered.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features])


def pca_variance(matrix: DataFrame, features: Sequence[str]) -> DataFrame:
    """Explained and cumulative variance share per component."""
    model = PCA(k=len(features), inputCol="features", outputCol="_p").fit(_vectors(matrix, features))
    shares = [float(v) for v in model.explainedVariance]
    rows = [(f"PC{i + 1}", v, sum(shares[: i + 1])) for i, v in enumerate(shares)]
    return matrix.sparkSession.createDataFrame(rows, "component string, explained double, cumulative double")


def pca_projection(matrix: DataFrame, features: Sequence[str], k: int = 2) -> DataFrame:
    """Centred rows projected on the first ``k`` components.

    The sign of a component is fixed by making its largest loading positive.
    """
    row = one_row(matrix, *[F.avg(f).alias(f) for f in features])
    centred = matrix.withColumns({f: F.col(f) - F.lit(row[f]) for f in features})
    rows = _vectors(centred, features)
    model = PCA(k=k, inputCol="features", outputCol="_p").fit(rows)
    loads = model.pc.toArray()
    signs = [1.0 if loads[np.argmax(np.abs(loads[:, i])), i] >= 0 else -1.0 for i in range(k)]
    spots = vector_to_array("_p")
    return model.transform(rows).select(*matrix.columns, *[(spots[i] * F.lit(signs[i])).alias(f"PC{i + 1}") for i in range(k)])


def davies_bouldin(matrix: DataFrame, features: Sequence[str], label: str = "cluster") -> float | None:
    """Mean over clusters of the worst (spread + spread) / centre distance.  Noise (-1) is left out."""
    rows = matrix.filter(F.col(label) != -1)
    centres = rows.groupBy(label).agg(F.count("*").alias("_n"), *[F.avg(f).alias(f"_c_{f}") for f in features])
    gap = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(f) - F.col(f"_c_{f}"), 2) for f in features]))
    spread = rows.join(centres, label).groupBy(label).agg(
        F.avg(gap).alias("_s"), F.first("_n").alias("_n"), *[F.first(f"_c_{f}").alias(f"_c_{f}") for f in features]
    )
    found = spread.limit(MAX_CLUSTERS + 1).collect()  # one row per cluster
    if len(found) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    if len(found) < 2 or sum(r["_n"] for r in found) <= len(found):
        return None
    found.sort(key=lambda r: r[label])
    middle = np.array([[r[f"_c_{f}"] for f in features] for r in found])
    width = np.array([r["_s"] for r in found])
    apart = np.sqrt(((middle[:, None] - middle[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    with np.errstate(divide="ignore"):
        worst = ((width[:, None] + width[None]) / apart).max(axis=1)
    return float(worst.mean())


def cluster_quality(matrix: DataFrame, features: Sequence[str], label: str = "cluster", name: str = "model") -> DataFrame:
    """Clusters, noise rows, squared-distance silhouette and Davies-Bouldin index.

    The silhouette uses squared Euclidean distances, for which a sum per cluster is
    enough; the plain one would need all pairs of rows.
    """
    facts = one_row(
        matrix, F.count_distinct(F.when(F.col(label) != -1, F.col(label))).alias("k"), F.count(F.when(F.col(label) == -1, 1)).alias("noise"),
        F.count(F.when(F.col(label) != -1, 1)).alias("n"),
    )
    silhouette = index = None
    if facts["k"] >= 2 and facts["n"] > facts["k"]:
        rows = _vectors(matrix.filter(F.col(label) != -1), features).withColumn("_l", F.col(label).cast("double"))
        silhouette = ClusteringEvaluator(predictionCol="_l", featuresCol="features", metricName="silhouette").evaluate(rows)
        index = davies_bouldin(matrix, features, label)
    row = [(name, facts["k"], facts["noise"], silhouette, index)]
    return matrix.sparkSession.createDataFrame(row, "model string, clusters long, noise long, silhouette_sq double, davies_bouldin double")
