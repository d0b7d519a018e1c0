"""Approximate dense search: inverted lists of clusters, and random projections."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dense


#: Share of the exact results that is wanted on the queries it is measured on, and how many these are. It is above 0.9,
#: so that other queries don't fall below that.
RECALL = 0.95
QUERIES = 200


class ClusterIndex:
    """Records routed to the nearest of some centroids; a query reads the lists of the centroids nearest to it."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids

    @classmethod
    def fit(cls, records: DataFrame, clusters: int, vector_col: str = "dense", seed: int = 7, iterations: int = 10) -> ClusterIndex:
        vectors = records.where(F.col(vector_col).isNotNull()).select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
        return cls(np.array(KMeans(k=clusters, seed=seed, maxIter=iterations).fit(vectors).clusterCenters()))

    def assign(self, records: DataFrame, vector_col: str = "dense") -> DataFrame:
        """records with the column cluster, the least by squared distance; to be written partitioned by it."""
        v = F.col(vector_col).cast("array<double>")
        far = [F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x) for c in self.centroids]
        distances = F.array(*far)
        return records.withColumn("cluster", (F.array_position(distances, F.array_min(distances)) - 1).cast("int"))

    def probed(self, query: list[float], probes: int) -> list[int]:
        return np.argsort(((self.centroids - np.asarray(query)) ** 2).sum(1), kind="stable")[:probes].tolist()

    def probes_for(self, assigned: DataFrame, k: int = 10, recall: float = RECALL, queries: int = QUERIES, metric: str = "cosine", id_col: str = "id", vector_col: str = "dense") -> int:
        """The least number of lists that hold this share of the exact k best, over queries that are records of the table.

        The queries are the first by a hash of their id, and each is compared with all records.
        """
        dim = self.centroids.shape[1]
        rows = assigned.where(F.size(vector_col) == dim).orderBy(F.xxhash64(id_col), id_col).limit(queries)
        asked = [(i, [float(x) for x in r[vector_col]]) for i, r in enumerate(rows.select(vector_col).collect())]
        table = assigned.sparkSession.createDataFrame(asked, "query_id bigint, query array<double>")
        best = dense.batch_search(assigned, table, k, metric, id_col, vector_col)
        lists = assigned.select(F.col(id_col).alias("id"), "cluster").distinct()
        found = best.join(lists, "id").groupBy("query_id", "cluster").agg(F.count("*").alias("n")).collect()
        place = {i: {c: at for at, c in enumerate(self.probed(v, len(self.centroids)))} for i, v in asked}
        held = np.bincount([place[r["query_id"]][r["cluster"]] for r in found], [r["n"] for r in found], len(self.centroids)) if found else np.ones(len(self.centroids))
        return int(np.searchsorted(np.cumsum(held), recall * held.sum() - 1e-9)) + 1

    def search(self, assigned: DataFrame, query: list[float], k: int = 10, probes: int = 3, **options) -> DataFrame:
        """Like dense.search, over the lists probed; a table partitioned by cluster is read in these parts alone."""
        return dense.search(assigned.where(F.col("cluster").isin(self.probed(query, probes))), query, k, **options)


def projection_search(records: DataFrame, query: list[float], k: int = 10, id_col: str = "id", vector_col: str = "dense", width: float = 0.5, tables: int = 5, seed: int = 7) -> DataFrame:
    """(id, distance): nearest by Euclidean distance among the records that share a projection bucket with the query."""
    from pyspark.ml.linalg import Vectors

    some = records.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(some)
    return model.approxNearestNeighbors(some, Vectors.dense(query), k).select("id", F.round("distCol", dense.DIGITS).alias("distance"))
