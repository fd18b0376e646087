"""Connected components of a distributed edge list by alternating large and small stars.

Every round is two aggregations and two joins; nothing is collected. Each task first reduces its own edges to
stars, so a few rounds are enough. Rounds are written to the shared scratch folder, which ends their lineage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm.common import by_partition, ship, table


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node each is linked with, for all nodes that are not the smallest themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _local_stars(batches):
    node = root = np.zeros(0, np.int64)
    for batch in batches:  # the forest of what came so far and the next batch's edges
        node, root = forest(np.concatenate([node, batch.column(0).to_numpy()]), np.concatenate([root, batch.column(1).to_numpy()]))
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["node", "root"])


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``, long, not null) but the roots themselves.

    ``root`` is the smallest node that can be reached. Loops and repeated edges do no harm; no edges, no rows.
    """
    ship(edges.sparkSession)
    stars = table(edges.select("a", "b").where("a <> b").mapInArrow(by_partition(_local_stars), "node long, root long"), "stars")
    for _ in range(most_rounds):
        # Settled when each node has one root and no root is itself a node with a root.
        many = stars.groupBy("node").agg(F.countDistinct("root").alias("n")).where("n > 1").select("node")
        inner = stars.select(F.col("root").alias("node")).join(stars.select("node"), "node", "left_semi")
        if many.unionByName(inner).limit(1).count() == 0:
            return stars.distinct()
        # Large stars: a node's neighbours above it move to its least neighbour. All neighbours below a node are
        # its roots, so the least one needs an aggregation by node only, of which there are few rows each; the hub
        # of a large star is on the join's other side, where Spark can split it.
        least = table(stars.groupBy("node").agg(F.min("root").alias("low")).select(F.col("node").alias("root"), "low"), "least")
        large = stars.join(least, "root", "left").select("node", F.coalesce("low", "root").alias("root")).distinct()
        # Small stars: a node and its roots move to the least of these.
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        moved = large.join(low, "node").where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        stars = table(moved.unionByName(low.select("node", F.col("low").alias("root"))).distinct(), "stars")
    raise RuntimeError("components did not settle")
