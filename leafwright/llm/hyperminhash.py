"""Near-duplicate detection with HyperMinHash sketches.

A text's shingles are hashed into buckets; of each bucket's least hash only the count of leading zeros and a
few mantissa bits are stored, and an empty bucket borrows the register of another one that is chosen alike for
all texts. Bands of registers are the keys under which texts meet. The share of equal registers, corrected for
registers that are equal by accident, estimates Jaccard similarity and decides which of those that met are
verified on their full shingle sets.

Work is done on *classes*, the distinct shingle sets, so exact copies never form pairs, and in stages, so that
a large group of near copies is never expanded into its pairs:

1. each class is verified against one class only: of the first classes of its band keys, the one met most often;
2. classes that meet under a frequent key and are not in one component by then are put into groups; a group
   is cut into blocks of one component or of small ones, and blocks are intersected exactly, as products of
   incidence matrices, unless both are of one component. Only a spanning forest of the links leaves a task;
3. under the other keys (a few classes each) pairs across components and groups are estimated and verified.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.llm.common import by_group, by_partition, map_batches, release, ship, table
from leafwright.llm.components import components, forest

_EMPTY = np.uint16(0xFFFF)
_MANTISSA = 10
_MAX = 2**63 - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than ``words`` make one shingle, none make none."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(s)])
    return np.unique(s)


@lru_cache(maxsize=4)
def _lenders(registers: int) -> np.ndarray:
    """For each register the order in which it asks the others when its bucket is empty (rank by register)."""
    return np.argsort(np.random.default_rng(registers).random((registers, registers)), axis=1).astype(np.uint16)


def sketch(shingles: np.ndarray, registers: int) -> np.ndarray:
    """Registers: leading zeros above mantissa bits of the least hash in each bucket; of an empty set all ones."""
    if not len(shingles):
        return np.full(registers, _EMPTY)
    bucket = (((shingles >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)
    least = np.full(registers, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, bucket, _mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)))
    fraction, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))  # 53 bits are exact
    mantissa = ((fraction - 0.5) * (1 << (_MANTISSA + 1))).astype(np.int64).clip(0)
    out = ((np.minimum(53 - exponent, 53) << _MANTISSA) | mantissa).astype(np.uint16)
    filled = np.zeros(registers, bool)
    filled[bucket] = True
    empty, full = np.flatnonzero(~filled), np.flatnonzero(filled)
    if len(empty):
        out[empty] = out[full[np.argmin(_lenders(registers)[np.ix_(empty, full)], axis=1)]]
    return out


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` registers (n sketches x bands)."""
    parts = registers.reshape(len(registers), -1, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for k in range(rows):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketches row by row, less the equal registers that accident explains."""
    registers = a.shape[1]
    level = 2.0 ** -np.arange(54)
    share = [np.exp(-np.outer(n / registers, level / 2)) - np.exp(-np.outer(n / registers, level)) for n in (na, nb)]
    accident = (share[0] * share[1]).sum(axis=1) / (1 << _MANTISSA)
    return ((a == b).mean(axis=1) - accident) / (1 - accident)


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int, errors: float = 5.0) -> np.ndarray:
    """Whether estimates are within ``errors`` standard errors of the similarity that is asked for, or above."""
    registers, least = a.shape[1], percent / 100
    own = registers * -np.expm1(-np.minimum(na, nb) / registers)  # registers that are not borrowed
    return estimate(a, b, na, nb) >= least - errors * np.sqrt(least * (1 - least) / own)


def _pack(text: str | None) -> bytes | None:
    return None if text is None else zstandard.compress(text.encode("utf-8", "surrogatepass"), 1)


def _unpack(data: bytes | None) -> str | None:
    return None if data is None else zstandard.decompress(data).decode("utf-8", "surrogatepass")


class _Sign:
    def __init__(self, names: list[str], words: int, registers: int):
        self.names, self.words, self.registers = names, words, registers

    def __call__(self, batch) -> dict:
        size, mark, regs, packed = [], [], [], []
        for text in batch.column(len(self.names)):
            text = text.as_py()
            s = shingle_set(text, self.words)
            size.append(len(s))
            mark.append(xxhash.xxh3_128_digest(s.tobytes()))
            regs.append(sketch(s, self.registers).tobytes())
            packed.append(_pack(text))
        out = {n: batch.column(k) for k, n in enumerate(self.names)}
        return out | {"_packed": pa.array(packed, pa.binary()), "n_shingles": np.array(size, np.int64), "_set": pa.array(mark, pa.binary()), "_registers": pa.array(regs, pa.binary())}


class _Unpack:
    def __init__(self, names: list[str]):
        self.names = names

    def __call__(self, batch) -> dict:
        return {n: batch.column(k) for k, n in enumerate(self.names)} | {"text": [_unpack(x) for x in batch.column(len(self.names)).to_pylist()]}


class _Bands:
    """``cid, band`` for every band of every class."""

    def __init__(self, rows: int):
        self.rows = rows

    def __call__(self, batches):
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_regs(batch.column(1)), self.rows)
                cid = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(keys.ravel())], names=["cid", "band"])


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


class _Likely:
    """Of rows ``a, b, a_registers, b_registers, a_n, b_n`` those pairs whose estimate allows a link."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, batches):
        for batch in batches:
            if batch.num_rows:
                found = likely(_regs(batch.column(2)), _regs(batch.column(3)), batch.column(4).to_numpy(), batch.column(5).to_numpy(), self.percent)
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(found)) for k in (0, 1)], names=["a", "b"])


class _Blocks:
    """A spanning forest of the links across components between two blocks (or in one), on full sets."""

    def __init__(self, words: int, percent: int, chunk: int = 4096):
        self.words, self.percent, self.chunk = words, percent, chunk

    def __call__(self, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        cid, comp, first = group.column("cid").to_numpy(), group.column("comp").to_numpy(), group.column("first").to_numpy(zero_copy_only=False)
        sets = [shingle_set(_unpack(x), self.words) for x in group.column("packed").to_pylist()]
        size = np.array([len(s) for s in sets])
        left = np.flatnonzero(first)
        right = np.flatnonzero(~first) if not first.all() else left
        values, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(seen > 1) - 1  # shingles of one text alone meet nothing
        row, column = np.repeat(np.arange(len(sets)), size), np.asarray(column)
        keep = seen[column] > 1
        row, column = row[keep], number[column[keep]]
        place = np.full(len(sets), -1)
        place[right] = np.arange(len(right))
        shared = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for low in range(0, int(number[-1]) + 1, self.chunk):
            at = slice(*np.searchsorted(column, [low, low + self.chunk]))
            incidence = np.zeros((len(sets), self.chunk), np.float32)
            incidence[row[at], column[at] - low] = 1
            shared += incidence[left] @ incidence[right].T
        shared = shared.astype(np.int64)  # counts are exact in single precision, a hundred times a count needn't be
        linked = 100 * shared >= self.percent * (size[left][:, None] + size[right] - shared)
        linked &= comp[left][:, None] != comp[right]
        x, y = np.nonzero(linked)
        a, b = forest(cid[left[x]], cid[right[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


class _Verify:
    """Links among rows ``a, b, a_packed, b_packed``; the set of an ``a`` that stays is kept."""

    def __init__(self, words: int, percent: int):
        self.words, self.percent = words, percent

    def __call__(self, batches):
        last, mine = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, mine = a, shingle_set(_unpack(x.as_py()), self.words)
                other = shingle_set(_unpack(y.as_py()), self.words)
                small, large = (mine, other) if len(mine) <= len(other) else (other, mine)
                shared = 0
                if len(small) * 100 >= self.percent * len(large) and len(small):
                    at = np.searchsorted(large, small)
                    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(bool(shared) and 100 * shared >= self.percent * (len(mine) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, bands: int = 40, rows: int = 6, frequent: int = 32, block: int = 1024, block_shingles: int = 1_000_000, with_text: bool = True) -> DataFrame:
    """All columns of ``docs`` with ``n_shingles``, ``component_id``, ``kept`` and ``first``.

    Texts are linked if 100 x intersection >= ``percent`` x union of their shingle sets; every link is verified
    on full sets. ``component_id`` is the least ``doc_id`` that links reach; ``kept`` says that it is the row's
    own; ``first`` holds for exactly one row of a component, that of the least id (ties: any one).
    Null texts and those without words have no shingles, are linked with nothing and stay. Rows that repeat are
    copies of each other. Null ids come last and stand for themselves. An empty table gives an empty result.
    Columns of ``docs`` that are named like the four new ones are replaced; without ``with_text`` the text is left out.
    A pair at J meets in no band with probability (1 - J**rows)**bands: 7e-9 at 0.85. Pairs of rare band keys whose
    estimate is over five standard errors too low are not verified. ``frequent``, ``block`` and ``block_shingles``
    bound what a task holds and have no effect on the result.
    """
    spark = docs.sparkSession
    ship(spark)
    added = ["n_shingles", "component_id", "kept", "first"]
    # Columns that are named like the working ones step aside.
    aside = {c: f"{c}{'_' * (1 + max(map(len, docs.columns)))}" for c in docs.columns if c in ("_packed", "_set", "_registers", "_rid", "_text", "first_place", "comp")}
    wanted, docs = docs.columns, docs.withColumnsRenamed(aside)
    names = [c for c in docs.columns if c not in added and c != "text"]
    registers = bands * rows
    schema = T.StructType(
        [docs.schema[c] for c in names]
        + [T.StructField("_packed", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("_set", T.BinaryType()), T.StructField("_registers", T.BinaryType())]
    )
    signed = map_batches(docs.select(*names, F.col("text").cast("string").alias("_text")), _Sign(names, words, registers), schema)
    signed = table(signed.withColumn("_rid", F.monotonically_increasing_id()), "signed")

    # A class is a distinct set; its number is that of its first row, and its place the least id and row in it.
    place = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(_MAX)).alias("doc"), F.col("_rid").alias("rid"))
    classes = table(signed.where("n_shingles > 0").groupBy("_set").agg(F.min("_rid").alias("cid"), F.min(place).alias("place")), "classes")
    heads = table(signed.select(F.col("_rid").alias("cid"), F.col("_registers").alias("registers"), F.col("n_shingles").alias("n")).join(classes.select("cid"), "cid", "left_semi"), "heads")

    # Band keys that several classes share, with the first of these and their number.
    met = heads.select("cid", "registers").mapInArrow(by_partition(_Bands(rows)), "cid long, band long")
    head = met.groupBy("band").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = table(met.join(head, "band"), "met")
    packed = signed.select(F.col("_rid").alias("cid"), F.col("_packed").alias("packed"))
    packed = table(packed.join(met.select("cid").distinct(), "cid", "left_semi"), "packed")
    release(spark)

    # 1. One pair for each class.
    votes = met.where("cid <> head").groupBy(F.col("head").alias("a"), F.col("cid").alias("b")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("b").agg(F.max(F.struct("votes", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")
    links = table(_verified(_estimated(best, heads, percent), packed, words, percent), "links")
    roots = components(links)
    release(spark)

    # 2. Groups that meet under frequent keys, cut into blocks and compared where components differ.
    def with_component(frame: DataFrame) -> DataFrame:
        return frame.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root")

    def mixed(frame: DataFrame, deals: int = 1) -> DataFrame:
        """Rows of the keys under which several components meet; a key's rows are dealt to ``deals`` tasks."""
        several = frame.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band")
        if deals == 1:
            return frame.join(several, "band", "left_semi")
        several = several.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
        return frame.withColumn("deal", F.pmod(F.xxhash64("cid"), F.lit(deals)).cast("int")).join(several, ["band", "deal"], "left_semi").drop("deal")

    # A frequent key has over ``frequent`` rows, so there are fewer copies of keys than rows.
    many = mixed(with_component(met.where(F.col("size") > frequent)), frequent)
    group = components(many.select(F.col("head").alias("a"), F.col("cid").alias("b")))
    members = group.select(F.col("node").alias("cid"), F.col("root").alias("grp")).unionByName(group.select(F.col("root").alias("cid"), F.col("root").alias("grp")).distinct())
    members = table(with_component(members).join(heads.select("cid", "n"), "cid"), "members")
    parts = members.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("total"))
    share = lambda count, total: F.greatest(F.ceil(count / block), F.ceil(total / block_shingles), F.lit(1)).cast("int")
    parts = parts.withColumn("own", share(F.col("count"), F.col("total"))).withColumn("large", (F.col("count") * 2 > block) | (F.col("own") > 1))
    rest = parts.where("not large").groupBy("grp").agg(F.sum("count").alias("count"), F.sum("total").alias("total")).select("grp", share(F.col("count"), F.col("total")).alias("rest"))
    parts = parts.join(rest, "grp", "left").select("grp", "comp", F.when(F.col("large"), F.col("comp")).alias("pure"), F.when(F.col("large"), F.col("own")).otherwise(F.col("rest")).alias("deal"))
    # A block is a component's number (none: several small ones) and a share of it.
    blocked = members.join(parts, ["grp", "comp"]).withColumn("share", F.pmod(F.xxhash64("cid"), F.col("deal")).cast("int")).select("grp", "cid", "comp", "pure", "share")
    blocked = table(blocked, "blocked")
    x = blocked.select("grp", F.coalesce("pure", F.lit(-1)).alias("pure"), "share").distinct()
    pairs = x.alias("x").join(x.select("grp", F.col("pure").alias("y_pure"), F.col("share").alias("y_share")).alias("y"), "grp")
    pairs = pairs.where("(pure < y_pure or pure = y_pure and share <= y_share) and (pure <> y_pure or pure = -1)").select("grp", "pure", "share", "y_pure", "y_share")
    own = pairs.select("*", F.col("pure").alias("p"), F.col("share").alias("s"), F.lit(True).alias("first"))
    theirs = pairs.where("pure <> y_pure or share <> y_share").select("*", F.col("y_pure").alias("p"), F.col("y_share").alias("s"), F.lit(False).alias("first"))
    rows_in = blocked.select("grp", "cid", "comp", F.coalesce("pure", F.lit(-1)).alias("p"), F.col("share").alias("s")).join(own.unionByName(theirs), ["grp", "p", "s"]).join(packed, "cid")
    dense = rows_in.groupBy("grp", "pure", "share", "y_pure", "y_share").applyInArrow(by_group(_Blocks(words, percent)), "a long, b long")
    links = table(links.unionByName(dense), "links")
    roots = components(links)
    release(spark)

    # 3. What is left under rare keys.
    few = mixed(with_component(met.where(F.col("size") <= frequent))).join(members.select("cid", "grp"), "cid", "left")
    few = few.select("band", F.col("cid").alias("a"), "comp", "grp")
    other = few.select("band", F.col("a").alias("b"), F.col("comp").alias("b_comp"), F.col("grp").alias("b_grp"))
    pairs = few.join(other, "band").where("a < b and comp <> b_comp and not coalesce(grp = b_grp, false)").select("a", "b").distinct()
    # Written, as a task that verifies and reduces its links to stars would hold two Python workers, and these outlive the stage.
    more = table(_verified(_estimated(pairs, heads, percent), packed, words, percent), "links")
    roots = components(links.unionByName(more))

    # The least place of each component goes back to the rows through their set.
    all_classes = with_component(classes)
    # Written, so that the join below isn't dealt by component: one may have a third of all classes.
    least = table(all_classes.groupBy("comp").agg(F.min("place").alias("first_place")), "least")
    lookup = table(all_classes.select("_set", "comp").join(least, "comp").select("_set", "first_place"), "lookup")
    out = signed.select(*names, "n_shingles", "_set", "_rid", *["_packed"] * with_text).join(lookup, "_set", "left")
    mine = F.col("doc_id").cast("long")
    found = F.when(F.col("first_place.doc") == _MAX, F.lit(None).cast("long")).otherwise(F.coalesce(F.col("first_place.doc"), mine))
    out = out.withColumn("component_id", found)
    out = out.withColumn("kept", mine.eqNullSafe(F.col("component_id")))
    out = out.withColumn("first", F.coalesce(F.col("first_place.rid") == F.col("_rid"), F.lit(True)))
    if not with_text:
        return out.select(*[F.col(c).alias({v: k for k, v in aside.items()}.get(c, c)) for c in names], *added)
    carried = [*names, *added]
    schema = T.StructType([*out.select(*carried).schema.fields, T.StructField("text", T.StringType())])
    out = map_batches(out.select(*carried, "_packed"), _Unpack(carried), schema)
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in wanted if c not in added], *added)


def _estimated(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    left = heads.select(F.col("cid").alias("a"), F.col("registers").alias("a_registers"), F.col("n").alias("a_n"))
    right = heads.select(F.col("cid").alias("b"), F.col("registers").alias("b_registers"), F.col("n").alias("b_n"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "a_registers", "b_registers", "a_n", "b_n")
    return rows.mapInArrow(by_partition(_Likely(percent)), "a long, b long")


def _verified(pairs: DataFrame, packed: DataFrame, words: int, percent: int) -> DataFrame:
    pairs = table(pairs, "likely")
    right = pairs.join(packed.select(F.col("cid").alias("b"), F.col("packed").alias("b_packed")), "b")
    left = packed.join(pairs.select(F.col("a").alias("cid")).distinct(), "cid", "left_semi").select(F.col("cid").alias("a"), F.col("packed").alias("a_packed"))
    return right.join(left, "a").select("a", "b", "a_packed", "b_packed").mapInArrow(by_partition(_Verify(words, percent)), "a long, b long")
