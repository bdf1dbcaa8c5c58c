"""Nearest neighbours: exact over all rows, or over the nearest clusters of a trained table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.vectors import METRICS


def knn(rows: DataFrame, query: list[float], k: int, metric: str = "l2", vector: str = "embedding", key: str = "vec_id", where: str | None = None) -> DataFrame:
    """key and distance of the k nearest rows (that meet `where`), ties by key.

    One pass with a bounded heap in each task; no shuffle of vectors.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    asked = F.array(*[F.lit(float(x)) for x in query])
    found = rows.where(where) if where else rows
    return found.where(F.col(vector).isNotNull()).select(key, METRICS[metric](F.col(vector), asked).alias("distance")).orderBy("distance", key).limit(k)


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


class ClusterIndex:
    """Rows assigned to k-means clusters; a query reads only the rows of the clusters nearest by the index's metric.

    Clusters are trained where nearness by the metric is Euclidean: on the vectors themselves (l2), on
    unit vectors (cosine), or on vectors given one more component that makes them all as long as the
    longest (ip: the nearest is then the one of the largest product).

    `centroid_ratio` (at most `most_centroids`, so centroids stay a few megabytes) and
    `samples_per_centroid` set how many centroids are trained, and on how many rows; below `flat_below`
    rows there is one cluster, so search is exact.
    """

    def __init__(self, rows: DataFrame, vector: str = "embedding", key: str = "vec_id", metric: str = "l2", centroid_ratio: float = 0.01, samples_per_centroid: int = 32, flat_below: int = 500, most_centroids: int = 4096, seed: int = 3):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        self.vector, self.key, self.metric, self.longest = vector, key, metric, 1.0
        usable = rows.where(F.col(vector).isNotNull())
        n, longest = usable.agg(F.count(F.lit(1)), F.max(_norm(F.col(vector)))).first()
        self.k = min(max(1, round(n * centroid_ratio)), most_centroids) if n >= flat_below else 1
        if self.k == 1:
            self.centroids, self.rows = [[]], usable.withColumn("cluster", F.lit(0))
            return
        self.longest = longest or 1.0
        v, size = F.col(vector).cast("array<double>"), _norm(F.col(vector))
        if metric == "cosine":
            v = F.transform(v, lambda x: x / F.greatest(size, F.lit(1e-300)))
        elif metric == "ip":
            v = F.concat(v, F.array(F.sqrt(F.greatest(F.lit(self.longest**2) - size * size, F.lit(0.0)))))
        ready = usable.withColumn("_v", array_to_vector(v))
        sample = ready.orderBy(F.xxhash64(key)).limit(self.k * samples_per_centroid)
        model = KMeans(k=self.k, seed=seed, featuresCol="_v", predictionCol="cluster", maxIter=10).fit(sample)
        self.centroids = [[float(x) for x in c] for c in model.clusterCenters()]
        self.rows = model.transform(ready).drop("_v")

    def write(self, path: str) -> None:
        """One folder a cluster, so that probing prunes files; searches read these from then on."""
        self.rows.write.mode("overwrite").partitionBy("cluster").parquet(path)
        self.rows = self.rows.sparkSession.read.parquet(path)

    def nearest(self, query: list[float], n: int) -> list[int]:
        """The n clusters nearest to the query by the index's metric."""
        size = math.sqrt(sum(x * x for x in query)) or 1.0
        q = [x / size for x in query] if self.metric == "cosine" else [*(x * self.longest / size for x in query), 0.0] if self.metric == "ip" else query
        return sorted(range(len(self.centroids)), key=lambda c: sum((x - y) ** 2 for x, y in zip(self.centroids[c], q)))[:n]

    def search(self, query: list[float], k: int, probe: float = 0.02, least: int = 1, where: str | None = None) -> DataFrame:
        """The k nearest among the nearest share `probe` of the clusters."""
        near = self.nearest(query, max(least, round(probe * self.k)))
        rows = self.rows if len(near) == len(self.centroids) else self.rows.where(F.col("cluster").isin(near))
        return knn(rows, query, k, self.metric, self.vector, self.key, where)

    def recall(self, queries: list[list[float]], k: int, probe: float) -> float:
        """The share of the true k nearest that a search with `probe` finds, over the queries."""
        found = 0
        for q in queries:
            true = {r[self.key] for r in knn(self.rows, q, k, self.metric, self.vector, self.key).collect()}
            found += len(true & {r[self.key] for r in self.search(q, k, probe).collect()}) / max(len(true), 1)
        return found / max(len(queries), 1)

    def probe_for(self, queries: list[list[float]], k: int, recall: float = 0.9) -> float:
        """The smallest of the probes 0.02, 0.04, ... 1 whose measured recall is enough."""
        probe = 0.02
        while probe < 1 and self.recall(queries, k, probe) < recall:
            probe *= 2
        return min(probe, 1.0)

    def info(self) -> DataFrame:
        """One row: rows, clusters, metric, dimensions."""
        one = self.rows.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(self.vector)).alias("dimensions"))
        return one.select("rows", F.lit(len(self.centroids)).alias("clusters"), F.lit(self.metric).alias("metric"), "dimensions")

    def clusters(self) -> DataFrame:
        """cluster and rows of each cluster that has any."""
        return self.rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))
