"""Centroid clustering of quantised vectors: Lloyd's rounds in whole numbers, on distinct vectors with multiplicities.

Vectors become whole numbers, equal ones are grouped and counted once (the shuffle combines copies before it moves
them), and each round is one pass over the distinct vectors: tasks add up weighted sums and give a row for each
cluster, and only these sums and the centroids are on the driver. Sums, floors and distances are exact. Clusters are
then joined back to the rows by the quantised vector. A vector that a thousandth of all rows share could meet in one
task there, so these vectors, of which there can't be more than a thousand, are broadcast instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.llm.common import by_partition, map_batches, ship, table

#: Quantised components are below this in size, so that a squared distance of 64 of them fits a long.
LARGEST = 1 << 26
#: Vectors that one in so many rows share are broadcast; there are no more of them than this.
FREQUENT = 1000


def quantised(vectors: DataFrame, scale: int = 64, size: int = 64, column: str = "embedding") -> DataFrame:
    """``vec_id, q``: floor(``scale`` * component), computed as double, of the vectors that can be kept.

    Kept are vectors of exactly ``size`` components, none null or not finite, and none that is ``LARGEST`` or more in
    size once quantised, as squared distances of such vectors don't fit a long.
    """
    scaled = F.transform(F.col(column), lambda x: F.floor(x.cast("double") * scale))
    fine = (F.size(column) == size) & F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < LARGEST))  # NaN is above all numbers
    rows = vectors.where(F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", F.transform(scaled, lambda x: x.cast("int")).alias("q"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number) and its squared distance."""
    distance = (q * q).sum(axis=1)[:, None] - 2 * (q @ centroids.T) + (centroids * centroids).sum(axis=1)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(q)), best]


class _Sums:
    """``cluster, n, sums`` of a partition: weighted counts and componentwise sums of what is nearest to each centroid."""

    owner = __name__

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids

    def __call__(self, batches):
        n, sums = np.zeros(len(self.centroids), np.int64), np.zeros(self.centroids.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                q, w = _matrix(batch.column(0)), batch.column(1).to_numpy()
                best, _ = nearest(q, self.centroids)
                for k in np.unique(best):
                    n[k] += w[best == k].sum()
                    sums[k] += w[best == k] @ q[best == k]
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])


class _Assign:
    """The distinct vectors with their nearest centroid and its squared distance."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids

    def __call__(self, batch) -> dict:
        best, distance = nearest(_matrix(batch.column(0)), self.centroids)
        return {"q": batch.column(0), "w": batch.column(1), "cluster": best, "distance": distance}


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, size: int = 64, column: str = "embedding", seed: str = "1") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that can be kept.

    The first centroids are the ``k`` kept vectors with the smallest SHA-256 (hexadecimal) of ``seed:vec_id``, in that
    order; equal ids are ordered by vector, vectors without an id never start a cluster. Each of ``rounds`` moves every
    centroid that has vectors to the floor of their mean. Repeated rows count each. With fewer vectors than ``k``
    there are fewer clusters; with none (or none with an id), no rows. Further columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept = quantised(vectors, scale, size, column)
    distinct = table(kept.groupBy("q").agg(F.count(F.lit(1)).alias("w")), "vectors")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where(F.col("vec_id").isNotNull()).select(mark.alias("mark"), "q").orderBy("mark", "q").limit(k).collect()
    centroids = np.array([r["q"] for r in first], np.int64).reshape(-1, size)
    kinds = T.StructType([distinct.schema["q"], distinct.schema["w"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not first:
        distinct = distinct.limit(0)
    for _ in range(rounds if first else 0):
        sums = distinct.mapInArrow(by_partition(_Sums(centroids)), "cluster long, n long, sums array<long>")
        whole = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(size)]).alias("sums"))
        for r in whole.collect():  # at most k rows
            centroids[r["cluster"]] = [int(x) // r["n"] for x in r["sums"]]
    assigned = table(map_batches(distinct, _Assign(centroids), kinds), "assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("w"))
    inertia = {r["cluster"]: int(r["x"]) for r in assigned.groupBy("cluster").agg(exact.alias("x")).collect()}  # at most k rows
    said = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(inertia)]
    about = spark.createDataFrame([s for s in said if s[2] < 1 << 63], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # Shares of all rows add up to one, so there are at most FREQUENT such vectors.
    total = assigned.agg(F.sum("w")).first()[0] or 0
    found = assigned.select("q", "cluster", "distance", (F.col("w") * FREQUENT >= total).alias("frequent"))
    often, rest = F.broadcast(found.where("frequent").drop("frequent")), found.where("not frequent").drop("frequent")
    rows = kept.join(often, "q").unionByName(kept.join(often.select("q"), "q", "left_anti").join(rest, "q"))
    return rows.join(F.broadcast(about), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
