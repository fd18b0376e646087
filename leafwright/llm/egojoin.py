"""Embedding near-duplicates by an epsilon grid order join.

Vectors are put on the unit sphere, where a cosine bound is a bound on distance, and projected on the leading
principal directions (fitted on a bounded sample; any orthonormal basis gives right results). Sorting by label
and then by the grid cells of these dimensions, cell width epsilon, is the epsilon grid order. The sequence is
cut into blocks of bounded size. Blocks of one label meet if their first cells are neighbours and the boxes
around them are within epsilon; two that meet are joined recursively: intervals of the sequence whose boxes
are provably distant are skipped, others are halved until they are small and then compared exactly, in double
precision. A task returns sums of links and a spanning forest, never the pairs, so cliques stay cheap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.llm.common import by_group, by_partition, map_batches, ship, table
from leafwright.llm.components import components, forest

_MAX = 2**63 - 1
_LEAF = 128


class _Sign:
    """Raw doubles, and a key for equal vectors of a label; both null for vectors that can't be linked."""

    def __call__(self, batch) -> dict:
        raw, key, size = [], [], []
        for values, label in zip(batch.column(1), batch.column(2).to_pylist()):
            x = None
            if values.is_valid and label is not None:
                parts = values.values
                if len(parts) and not parts.null_count:
                    x = parts.to_numpy(zero_copy_only=False).astype("<f8")
                    if not (np.isfinite(x).all() and x.any()):
                        x = None
            raw.append(None if x is None else x.tobytes())
            key.append(None if x is None else xxhash.xxh3_128_digest(raw[-1] + label.to_bytes(8, "little", signed=True)))
            size.append(0 if x is None else len(x))
        return {"vec_id": batch.column(0), "label": batch.column(2), "raw": pa.array(raw, pa.binary()), "_key": pa.array(key, pa.binary()), "size": np.array(size, np.int64)}


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)  # lest squares overflow
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def leading_basis(sample: list[bytes], dims: int) -> dict[int, np.ndarray]:
    """For each vector length in the sample the ``dims`` directions of largest variance (columns)."""
    by_size: dict[int, list[bytes]] = {}
    for raw in sample:
        by_size.setdefault(len(raw) // 8, []).append(raw)
    out = {}
    for size, rows in by_size.items():
        x = _unit(np.frombuffer(b"".join(rows), "<f8").reshape(-1, size))
        x = x - x.mean(axis=0)
        out[size] = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :dims]
    return out


class _Project:
    def __init__(self, basis: dict[int, np.ndarray], dims: int):
        self.basis, self.dims = basis, dims

    def __call__(self, batch) -> dict:
        size = batch.column(3).to_numpy()
        out = np.zeros((batch.num_rows, self.dims))
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            x = _unit(_matrix(batch.column(2).take(pa.array(at))))
            p = x @ self.basis[n] if n in self.basis else x[:, : self.dims]
            out[at, : p.shape[1]] = p
        return {"cid": batch.column(0), "label": batch.column(1), "raw": batch.column(2), "size": batch.column(3), "weight": batch.column(4), "p": pa.array(list(out), pa.list_(pa.float64()))}


class _Cut:
    """Blocks of at most ``most`` vectors of one label and size from a sorted partition."""

    def __init__(self, most: int):
        self.most = most

    def __call__(self, batches):
        from pyspark import TaskContext

        number, last, held = TaskContext.get().partitionId() << 36, None, 0
        for batch in batches:
            ids = []
            for key in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if key != last or held == self.most:
                    number, last, held = number + 1, key, 0
                held += 1
                ids.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=[*batch.schema.names, "block"])


class _Interval:
    """A run of a block's sequence with the box around its projections, halved on demand."""

    __slots__ = ("start", "end", "low", "high", "p", "parts")

    def __init__(self, p: np.ndarray, start: int, end: int):
        self.p, self.start, self.end, self.parts = p, start, end, None
        self.low, self.high = p[start:end].min(axis=0), p[start:end].max(axis=0)

    def halves(self):
        if self.parts is None:
            middle = (self.start + self.end) // 2
            self.parts = _Interval(self.p, self.start, middle), _Interval(self.p, middle, self.end)
        return self.parts


def _near(x: _Interval, y: _Interval, far2: float) -> bool:
    gap = np.maximum(0, np.maximum(x.low - y.high, y.low - x.high))
    return float(gap @ gap) <= far2


def _leaves(x: _Interval, y: _Interval, far2: float):
    """Pairs of small intervals that are not provably distant; of an interval with itself each pair once."""
    todo = [(x, y)]
    while todo:
        x, y = todo.pop()
        if x is not y and not _near(x, y, far2):
            continue
        if x.end - x.start <= _LEAF and y.end - y.start <= _LEAF:
            yield x, y
        elif x is y:
            a, b = x.halves()
            todo += [(a, a), (a, b), (b, b)]
        elif x.end - x.start >= y.end - y.start:
            todo += [(h, y) for h in x.halves()]
        else:
            todo += [(x, h) for h in y.halves()]


class _Join:
    """Rows (cid, links, null) and (node, null, root) of one pair of blocks."""

    def __init__(self, cosine: float):
        self.cosine = cosine
        self.far2 = 2 - 2 * cosine + 1e-9

    def __call__(self, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        block = group.column("block").to_numpy()
        p = np.array(group.column("p").to_pylist())
        order = np.lexsort([*np.floor(p / np.sqrt(self.far2)).T[::-1], block])
        block, p = block[order], p[order]
        cid, weight = group.column("cid").to_numpy()[order], group.column("weight").to_numpy()[order]
        raw = _matrix(group.column("raw").take(pa.array(order)).combine_chunks())
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)
        norm = np.sqrt((raw * raw).sum(axis=1))
        cut = int(np.searchsorted(block, block[0], side="right"))
        left = _Interval(p, 0, cut)
        right = _Interval(p, cut, len(p)) if cut < len(p) else left
        links, a, b = np.zeros(len(p), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in _leaves(left, right, self.far2):
            i, j = slice(x.start, x.end), slice(y.start, y.end)
            near = raw[i] @ raw[j].T / (norm[i, None] * norm[j]) >= self.cosine
            if x is y:
                np.fill_diagonal(near, False)
                links[i] += near @ weight[j]
                near = np.triu(near)
            else:
                links[i] += near @ weight[j]
                links[j] += weight[i] @ near
            at = np.nonzero(near)
            if len(at[0]):
                u, v = forest(at[0] + x.start, at[1] + (y.start if x is not y else x.start))
                a.append(u)
                b.append(v)
        node, root = forest(cid[np.concatenate(a)], cid[np.concatenate(b)])
        linked = np.flatnonzero(links)
        return pa.table({
            "cid": pa.array(np.concatenate([cid[linked], node]), pa.int64()),
            "links": pa.array([*links[linked].tolist(), *[None] * len(node)], pa.int64()),
            "root": pa.array([*[None] * len(linked), *root.tolist()], pa.int64()),
        })


def epsilon_components(vectors: DataFrame, cosine: float = 0.93, dims: int = 8, block: int = 4096, sample: int = 20_000) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding, label``.

    Two vectors are linked if their labels are equal and not null, they have the same length, and their cosine
    is at least ``cosine``. Vectors that are null, empty, zero, or hold null or non-finite components are linked
    with nothing. Rows that repeat are vectors of their own, linked with each other. ``component_id`` is the
    least ``vec_id`` that links reach; null ids come last. An empty table gives an empty result; further
    columns are ignored. ``sample`` bounds the rows on which the principal directions are fitted, ``block`` a
    task's vectors; neither has an effect on the result.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.LongType()), T.StructField("raw", T.BinaryType()), T.StructField("_key", T.BinaryType()), T.StructField("size", T.LongType())])
    rows = map_batches(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), F.col("label").cast("long").alias("label")), _Sign(), schema)
    rows = table(rows.withColumn("_rid", F.monotonically_increasing_id()), "vectors")
    fitted = [bytes(r["raw"]) for r in rows.where(F.col("raw").isNotNull()).orderBy(F.xxhash64("_rid")).select("raw").limit(sample).collect()]
    basis = leading_basis(fitted, dims)

    place = F.struct(F.coalesce("vec_id", F.lit(_MAX)).alias("vec"), F.col("_rid").alias("rid"))
    classes = table(rows.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("_rid").alias("cid"), F.count(F.lit(1)).alias("weight"), F.min(place).alias("place")), "classes")
    heads = rows.select(F.col("_rid").alias("cid"), "label", "raw", "size").join(classes.select("cid", "weight"), "cid")
    projected = T.StructType([T.StructField(n, t) for n, t in (("cid", T.LongType()), ("label", T.LongType()), ("raw", T.BinaryType()), ("size", T.LongType()), ("weight", T.LongType()), ("p", T.ArrayType(T.DoubleType())))])
    placed = map_batches(heads.select("cid", "label", "raw", "size", "weight"), _Project(basis, dims), projected)
    epsilon = float(np.sqrt(2 - 2 * cosine + 1e-9))
    cells = [F.floor(F.col("p")[k] / epsilon) for k in range(dims)]
    placed = table(placed, "projected")
    count = placed.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // block)))
    order = ["label", "size", *cells, F.xxhash64("cid")]
    sequence = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = table(sequence.mapInArrow(by_partition(_Cut(block)), T.StructType([*projected.fields, T.StructField("block", T.LongType())])), "blocks")

    boxes = blocks.groupBy("label", "size", "block").agg(F.array(*[F.min(F.col("p")[k]) for k in range(dims)]).alias("low"), F.array(*[F.max(F.col("p")[k]) for k in range(dims)]).alias("high"))
    boxes = table(boxes, "boxes")
    first = F.explode(F.sequence(F.floor(F.col("low")[0] / epsilon), F.floor(F.col("high")[0] / epsilon))).alias("cell")
    mine = boxes.select("label", "size", F.col("block").alias("x"), F.col("low").alias("x_low"), F.col("high").alias("x_high"), first)
    theirs = boxes.select("label", "size", F.col("block").alias("y"), F.col("low").alias("y_low"), F.col("high").alias("y_high"), first)
    theirs = theirs.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    gap = [F.greatest(F.lit(0.0), F.col("x_low")[k] - F.col("y_high")[k], F.col("y_low")[k] - F.col("x_high")[k]) for k in range(dims)]
    meet = mine.join(theirs, ["label", "size", "cell"]).where(F.col("x") <= F.col("y")).where(sum(g * g for g in gap) <= epsilon * epsilon).select("x", "y").distinct()
    sides = meet.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    joined = blocks.select("block", "cid", "weight", "raw", "p").join(sides, "block").groupBy("x", "y").applyInArrow(by_group(_Join(cosine)), "cid long, links long, root long")
    joined = table(joined, "joined")

    links = joined.where(F.col("links").isNotNull()).groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(joined.where(F.col("root").isNotNull()).select(F.col("cid").alias("a"), F.col("root").alias("b")))
    known = classes.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    # Written, so that the join below isn't dealt by root: one root may have a third of all vectors.
    least = table(known.groupBy("root").agg(F.min("place").alias("first_place")), "least")
    known = known.join(links, "cid", "left").join(least, "root").select("_key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "first_place")
    out = rows.select("vec_id", "_key").join(table(known, "lookup"), "_key", "left")
    found = F.when(F.col("first_place.vec") == _MAX, F.lit(None).cast("long")).otherwise(F.coalesce("first_place.vec", "vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), found.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
