"""The prefix trie of conversations: a row for every distinct beginning, with counts of what goes on from it.

A conversation is the string of its turns, each a fixed-width hash, so binary order of the strings sorts
conversations turn by turn and one with another's beginning stands next to it. The trie then is the Cartesian tree
over the common prefix lengths (LCPs) of neighbours: a node is a maximal interval in which no LCP is below its depth.

1. conversations are sorted over blocks (range partitions by string and id, so copies can be split);
2. each block finds the nearest smaller LCP to both sides of each position with a stack, merges positions of equal
   LCP into one interval, and expands the depths between an interval and the one around it. What doesn't touch the
   block's ends is finished there; for the ends' own prefixes it gives partial sums;
3. from the LCPs between blocks and the least LCP in each, the nearest smaller value tells in which block each
   partial interval starts; partials of one start and depth are added up. Two whole numbers a block go through the
   driver for that, nothing else does;
4. nodes whose parent is such an interval get its id by a join on their block.

A conversation's hashes are sorted as one value, so 16 bytes for each of its turns must fit into a task, as must a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.llm.common import by_partition, map_batches, ship, table

#: Bytes of a turn's hash.
WIDTH = 16
_ENDLESS = 2**31 - 1

_PIECE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("kind", "block", "side", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "equal", "ended", "before", "last")]
    + [T.StructField("ends", T.StringType()), T.StructField("first_keys", T.BinaryType()), T.StructField("last_keys", T.BinaryType()), T.StructField("first_sizes", T.ArrayType(T.LongType()))]
)
_CLOSED, _OPEN, _SUMMARY = range(3)


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, keys, sizes``: each conversation's turns as hashes of 16 bytes, and the UTF-8 bytes of their texts.

    Turns are ordered by ``turn``, null first; turns of one number by the hash. Null roles and texts count as empty.
    Rows without a ``conv_id`` belong to no conversation. Repeated rows are turns of their own; further columns are
    ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", F.unhex(F.substring(F.sha2(said, 256), 1, 2 * WIDTH)).alias("key"), F.octet_length(text).cast("long").alias("size"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    keys = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), ""))
    return rows.select("conv_id", keys.alias("keys"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def rebuilt(rows: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """Sequences that share beginnings: the first h turns of conversation c - c % ``group``, then c's own after its first h.

    h is the unsigned CRC-32 of c in decimal, modulo ``most`` + 1. A first conversation that doesn't exist gives no
    turns. ``%`` keeps the sign of c, as in SQL.
    """
    rows = table(rows, "sequences")
    heads = rows.select(F.col("conv_id").alias("first_id"), F.expr(f"substring(keys, 1, {most * WIDTH})").alias("head"), F.slice("sizes", 1, most).alias("head_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    both = rows.withColumn("h", h).withColumn("first_id", F.col("conv_id") - F.col("conv_id") % group).join(heads, "first_id", "left")
    keys = F.expr(f"concat(coalesce(substring(head, 1, h * {WIDTH}), x''), substring(keys, h * {WIDTH} + 1, octet_length(keys)))")
    sizes = F.expr("concat(coalesce(slice(head_sizes, 1, h), cast(array() as array<bigint>)), slice(sizes, h + 1, size(sizes)))")
    return both.select("conv_id", keys.alias("keys"), sizes.alias("sizes"))


def _common(symbols: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """LCP of each row with the one before it; 0 for the first."""
    out = np.zeros(len(n), np.int64)
    both = np.minimum(n[1:], n[:-1])
    if both.sum():
        row = np.repeat(np.arange(len(both)), both)
        place = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
        differs = (symbols[start[1:][row] + place] != symbols[start[:-1][row] + place]).any(axis=1)
        least = np.where(differs, place, _ENDLESS)
        filled = np.flatnonzero(both)
        out[1 + filled] = np.minimum(np.minimum.reduceat(least, (np.cumsum(both) - both)[filled]), both[filled])
    return out


def _nearest_smaller(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position but the first the nearest one to the left and right with a smaller value; 0 and the length where there is none."""
    m = len(lcp)
    left, right, values, stack = [0] * m, [m] * m, lcp.tolist(), []
    for i in range(1, m):
        while stack and values[stack[-1]] > values[i]:
            right[stack.pop()] = i
        if stack:
            left[i] = left[stack[-1]] if values[stack[-1]] == values[i] else stack[-1]
        stack.append(i)
    return np.array(left, np.int64), np.array(right, np.int64)


class _Least:
    """Least value of ranges, from the least ones of all stretches whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            half = 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of ``values[low:high]``, none of them empty."""
        out = np.zeros(len(low), np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - 2**k])
        return out


class _Block:
    """Finished nodes, partial sums of the prefixes of its first and last conversation, and a summary of one block."""

    owner = __name__

    def __call__(self, batches):
        whole = [b for b in batches if b.num_rows]
        if whole:
            rows = pa.Table.from_batches(whole).combine_chunks()
            del whole
            yield from self.pieces(rows).to_batches(max_chunksize=20_000)

    def pieces(self, rows: pa.Table) -> pa.Table:
        block, conv = rows.column("block")[0].as_py(), rows.column("conv_id").to_numpy()
        keys, sizes = rows.column("keys").combine_chunks(), rows.column("sizes").combine_chunks()
        n = np.diff(sizes.offsets.to_numpy())
        start = np.cumsum(n) - n
        symbols = np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, WIDTH // 8)
        total = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy())]).astype(np.int64)
        lcp, m, least = _common(symbols, start, n), len(n), _Least(conv)
        upto = lambda row, depth: total[start[row] + np.maximum(depth, 0)] - total[start[row]]  # noqa: E731  bytes of so many first turns
        shared = upto(np.arange(m), lcp)
        # A conversation's last copy ends a path if nothing goes on from it; the block's last one is judged later.
        leaf = np.append(lcp[1:] < n[:-1], False)
        sums = {k: np.concatenate([[0], np.cumsum(v)]) for k, v in (("leaf", leaf), ("shared", shared))}
        same = np.append(False, (lcp[1:] == n[1:]) & (lcp[1:] == n[:-1]))
        run = np.cumsum(~same) - 1
        copies = np.bincount(run)[run]  # from a run's first row on

        def measured(low, high, depth):
            """What an interval adds up to at the depth of its own: the rows from ``low`` to before ``high``."""
            ended = np.where(n[low] == depth, copies[low], 0)
            return {"conv_id": least(low, high), "n_convs": high - low, "n_leaves": sums["leaf"][high] - sums["leaf"][low], "saved": sums["shared"][high] - sums["shared"][low + 1], "ended": ended}

        left, right = _nearest_smaller(lcp)
        # Merged intervals that touch neither end of the block, and the tails of conversations beyond their neighbours.
        pairs, at, equal = np.unique(left[1:] * (m + 1) + right[1:], return_index=True, return_counts=True)
        low, high, depth = pairs // (m + 1), pairs % (m + 1), lcp[1:][at]
        inner = (low > 0) & (high < m)
        low, high, depth, equal = low[inner], high[inner], depth[inner], equal[inner]
        middle = np.arange(1, m - 1)
        tail = middle[n[middle] > np.maximum(lcp[middle], lcp[middle + 1])]
        low, high, depth, equal = (np.concatenate(x).astype(np.int64) for x in ((low, tail), (high, tail + 1), (depth, n[tail]), (equal, 0 * tail)))
        out = []
        if len(low):
            near = np.where(lcp[low] >= lcp[high], low, high)  # where the interval around it is found
            found = measured(low, high, depth)
            up_low, up_high = left[near], right[near]
            inside = (up_low > 0) & (up_high < m)
            up = np.where(inside, least(np.where(inside, up_low, 0), np.where(inside, up_high, 1)), 0)
            side = np.where(inside, -1, np.where(up_low == 0, 0, 1))
            reach = depth - lcp[near]
            each = np.repeat(np.arange(len(low)), reach)
            deep = lcp[near][each] + 1 + np.arange(len(each)) - np.repeat(np.cumsum(reach) - reach, reach)
            own, top = deep == depth[each], deep == lcp[near][each] + 1
            ends = [None] * len(each)
            for k in np.flatnonzero(own & (found["ended"][each] > 0)):
                at = low[each[k]]
                ends[k] = hashlib.sha256(",".join(map(str, conv[at : at + found["ended"][each[k]]].tolist())).encode()).hexdigest()
            parent = pa.array(np.where(top, up[each], found["conv_id"][each]), pa.int64(), mask=top & ~inside[each])
            out.append({
                "kind": np.full(len(each), _CLOSED), "block": np.full(len(each), block), "side": pa.array(side[each], pa.int64(), mask=~top | inside[each]), "depth": deep,
                "conv_id": found["conv_id"][each], "parent_conv_id": parent, "n_convs": found["n_convs"][each], "n_children": np.where(own, (equal + 1 - found["ended"])[each], 1),
                "n_leaves": found["n_leaves"][each], "saved": found["saved"][each] - (found["n_convs"][each] - 1) * upto(low[each], deep - 1), "ends": pa.array(ends, pa.string()),
            })
        # Prefixes of the first conversation, and those of the last one that don't reach back to the first.
        falling = np.minimum.accumulate(lcp[1:])
        rising = np.minimum.accumulate(lcp[1:][::-1])
        lowest = int(falling[-1]) if m > 1 else _ENDLESS
        for side in (0, 1):
            depth = np.arange(0 if side == 0 else min(lowest, n[-1]) + 1, n[-1 if side else 0] + 1)
            if not len(depth):
                continue
            low_so_far, values = (falling, lcp[1:]) if side == 0 else (rising, lcp[1:][::-1])
            length = 1 + np.searchsorted(-low_so_far, -depth, side="right")
            low, high = (np.zeros(len(depth), np.int64), length) if side == 0 else (m - length, np.full(len(depth), m))
            found = measured(low, high, depth)
            equal = np.bincount(values[values == low_so_far], minlength=depth[-1] + 1)[depth]
            ends = [",".join(map(str, conv[a : a + k].tolist())) if k else None for a, k in zip(low, found["ended"])]
            out.append({"kind": np.full(len(depth), _OPEN), "block": np.full(len(depth), block), "side": np.full(len(depth), side), "depth": depth, **found, "equal": equal, "before": upto(low, depth - 1), "last": (high == m).astype(np.int64), "ends": pa.array(ends, pa.string())})
        out.append({"kind": [_SUMMARY], "block": [block], "depth": [int(n[-1])], "equal": [lowest], "first_keys": keys[:1].cast(pa.binary()), "last_keys": keys[m - 1 :].cast(pa.binary()), "first_sizes": sizes[:1].cast(pa.list_(pa.int64()))})
        return pa.concat_tables([self.shaped(x) for x in out])

    @staticmethod
    def shaped(part: dict) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        size = len(part["kind"])
        schema = to_arrow_schema(_PIECE)
        return pa.table([(part[f.name] if isinstance(part[f.name], pa.Array) else pa.array(part[f.name])).cast(f.type) if f.name in part else pa.nulls(size, f.type) for f in schema], schema=schema)


class _Joint:
    """LCP of a block's first conversation with the last one of the block before, and the bytes of that prefix."""

    def __call__(self, batch) -> dict:
        length, shared = [], []
        for mine, other, sizes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            a, b = (np.frombuffer(x, np.uint64).reshape(-1, WIDTH // 8) for x in (mine, other))
            k = min(len(a), len(b))
            differs = np.flatnonzero((a[:k] != b[:k]).any(axis=1))
            length.append(int(differs[0]) if len(differs) else k)
            shared.append(sum(sizes[: length[-1]]))
        return {"block": batch.column(0), "lcp": np.array(length, np.int64), "shared": np.array(shared, np.int64)}


class _Starts:
    """For partial intervals the place of the nearest smaller value before them, and what the joints add to their sums."""

    def __init__(self, blocks: list[int], joints: list[int], shared: list[int], least: list[int], last: list[int]):
        self.rank = {b: r for r, b in enumerate(blocks)}
        self.values = np.ravel(np.column_stack([joints, least])).astype(np.int64) if blocks else np.zeros(0, np.int64)
        self.shared, self.last = np.array(shared), np.array(last)

    def before(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for d in np.unique(depth):
            smaller = np.maximum.accumulate(np.where(self.values < d, np.arange(len(self.values)), -1))
            out[depth == d] = smaller[at[depth == d]]
        return out

    def __call__(self, batch) -> dict:
        col = {n: batch.column(n) for n in batch.schema.names}
        num = {n: col[n].to_numpy() for n in ("block", "side", "depth", "n_leaves", "saved", "equal", "last")}
        rank = np.array([self.rank[b] for b in num["block"].tolist()], np.int64)
        at, depth = 2 * rank + num["side"], num["depth"]
        joint = self.values[2 * rank]
        on = (num["side"] == 0) & (joint >= depth)
        following = np.append(self.values[2::2], -1)[rank]  # the joint with the block after
        return col | {
            "place": self.before(at, depth), "parent_place": self.before(at, depth - 1),
            "saved": num["saved"] + np.where(on, self.shared[rank], 0), "equal": num["equal"] + (on & (joint == depth)),
            "n_leaves": num["n_leaves"] + ((num["last"] == 1) & (following < self.last[rank])),
        }


class _Digests:
    """SHA-256 of the parts of each ``place, depth``, which come in order; a hash object is all that is kept."""

    owner = __name__

    def __call__(self, batches):
        now, state = None, None
        for batch in batches:
            done = []
            for place, depth, part in zip(*(batch.column(n).to_pylist() for n in ("place", "depth", "ends"))):
                if (place, depth) != now:
                    if state:
                        done.append((*now, state.hexdigest()))
                    now, state = (place, depth), hashlib.sha256(part.encode())
                else:
                    state.update(b"," + part.encode())
            yield self.rows(done)
        if state:
            yield self.rows([(*now, state.hexdigest())])

    @staticmethod
    def rows(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["place", "depth", "ends_sha256"])


def prefix_trie(rows: DataFrame, blocks: int | None = None) -> DataFrame:
    """A row for each node of the trie of ``conv_id, keys, sizes`` (as ``sequences`` gives them; ids that differ).

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves`` (nodes without children in the subtree), ``saved_tokens`` (bytes of the subtree's last turns that
    needn't be said again) and ``ends_sha256`` (of the ids that end here, ascending, with commas between). A
    conversation without turns is a member of the root. No conversations, no nodes, not even a root. ``blocks`` is the
    number of range partitions, by default that of the session's shuffles; the result doesn't depend on it.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = table(rows.select("conv_id", "keys", "sizes"), "strings")
    dealt = rows.repartitionByRange(blocks or int(spark.conf.get("spark.sql.shuffle.partitions")), "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    pieces = table(dealt.select(F.spark_partition_id().alias("block"), "conv_id", "keys", "sizes").mapInArrow(by_partition(_Block()), _PIECE), "pieces")
    # A few whole numbers for each block that has rows: no more than there are partitions.
    summary = pieces.where(F.col("kind") == _SUMMARY)
    known = sorted(summary.select("block", "equal", "depth").collect())
    order = [r["block"] for r in known]
    steps = spark.createDataFrame(list(zip(order[1:], order[:-1])), "block long, earlier long")
    ends = summary.select("block", "first_keys", "first_sizes").join(F.broadcast(steps), "block").join(summary.select(F.col("block").alias("earlier"), "last_keys"), "earlier")
    joints = {r["block"]: r for r in map_batches(ends.select("block", "first_keys", "last_keys", "first_sizes"), _Joint(), T.StructType([T.StructField(n, T.LongType()) for n in ("block", "lcp", "shared")])).collect()}
    starts = _Starts(order, [joints[b]["lcp"] if b in joints else -1 for b in order], [joints[b]["shared"] if b in joints else 0 for b in order], [r["equal"] for r in known], [r["depth"] for r in known])
    taken = ["block", "side", "depth", "conv_id", "n_convs", "n_leaves", "saved", "equal", "ended", "before", "last", "ends"]
    schema = T.StructType([*[_PIECE[n] for n in taken], T.StructField("place", T.LongType()), T.StructField("parent_place", T.LongType())])
    parts = table(map_batches(pieces.where(F.col("kind") == _OPEN).select(*taken), starts, schema), "parts")
    node = ["place", "depth"]
    sums = parts.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.min("parent_place").alias("parent_place"), F.sum("n_convs").alias("n_convs"), (F.sum("equal") + 1 - F.sum("ended")).alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), (F.sum("saved") - (F.sum("n_convs") - 1) * F.max("before")).alias("saved"),
    )
    sums = table(sums, "spanning")
    digests = parts.where("ended > 0").select(*node, "block", "ends").repartition(*node).sortWithinPartitions(*node, "block").select(*node, "ends").mapInArrow(by_partition(_Digests()), "place long, depth long, ends_sha256 string")
    up = sums.select(F.col("place").alias("parent_place"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    spanning = sums.join(up, ["parent_place", "depth"], "left").join(digests, node, "left")
    owner = parts.select("block", "side", *node).join(sums.select(*node, F.col("conv_id").alias("outer_id")), node)
    owner = owner.select("block", "side", (F.col("depth") + 1).alias("depth"), "outer_id")
    closed = pieces.where(F.col("kind") == _CLOSED).select("block", "side", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", F.col("ends").alias("ends_sha256"))
    inner = closed.where("side is null").unionByName(closed.where("side is not null").join(owner, ["block", "side", "depth"]).withColumn("parent_conv_id", F.col("outer_id")).drop("outer_id"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return inner.select(*names).unionByName(spanning.select(*names)).withColumnRenamed("saved", "saved_tokens").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
