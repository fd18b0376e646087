"""Packing documents into fixed windows by lexical retrieval.

Every document becomes its token ids and an end token. A pass over all documents gives the corpus statistics
that BM25 needs (document frequency of every vocabulary entry, mean length); their size is bounded by the
vocabulary. Then every document gets a route: the terms that a weighted minhash draws from it, in order, terms
of high BM25 weight most likely, so documents that share such terms get the same first terms. The documents are
dealt into shards of bounded size by ranges of routes, wherever their rows lie; a term that many documents drew
first is split by what they drew next. Each shard holds an inverted index of its documents. A seed document opens a window, the index returns its unused neighbours by BM25 score, and
they fill the window one after another; the last one is cut where the window is full and its rest seeds the
next window. So all windows but a shard's last are exactly full, and the last is cut into sequences whose
lengths are powers of two, which need no padding either.

A seed's neighbours are thus those of its shard. ``neighbours`` is the exact search: every shard's index answers every
query, and the best of all shards are the answer, however many shards there are.
"""

from __future__ import annotations

import zlib
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.llm.bpe import encoder
from leafwright.llm.common import by_partition, map_batches, ship, table, vocabulary_path

_TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType())])
_PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("ids", T.BinaryType())]
)


class _Encode:
    """Ids as unsigned 16-bit integers where the vocabulary allows, otherwise 32-bit."""

    owner = encoder.__module__  # whose caches it uses

    def __init__(self, path: str, end_id: int, kind: str):
        self.path, self.end, self.kind = path, np.array([end_id], kind).tobytes(), kind

    def __call__(self, batch) -> dict:
        found = encoder(self.path).encode_all(batch.column(1).to_pylist())
        ids = [x.astype(self.kind).tobytes() + self.end for x in found]
        width = np.dtype(self.kind).itemsize
        return {"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary()), "n": np.array([len(x) // width for x in ids], np.int64)}


class _Route:
    """Each document with its route, as bytes that sort like it, and the range it falls in."""

    def __init__(self, kind: str, idf: np.ndarray, mean: float, k1: float, b: float, levels: int = 4, bounds: np.ndarray | None = None):
        self.kind, self.idf, self.settings, self.levels, self.bounds = kind, idf, (mean, k1, b), levels, bounds
        self.draw = np.log(np.random.default_rng(5).random(len(idf)))

    def routes(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each document the terms with the largest draws; a term is first with a probability by the square of its weight."""
        doc, term, weight = _weights(flat, sizes, self.idf, *self.settings)
        with np.errstate(divide="ignore"):
            drawn = self.draw[term] / np.square(weight, dtype=np.float64)
        terms = np.bincount(doc, minlength=len(sizes))
        start = np.cumsum(terms) - terms
        out = np.full((len(sizes), self.levels), 0xFFFFFFFF, ">u4")
        for level in range(self.levels):
            most = np.maximum.reduceat(drawn, start)
            found = np.flatnonzero((drawn == np.repeat(most, terms)) & (drawn > -np.inf))
            found = found[np.flatnonzero(np.diff(doc[found], prepend=-1))]  # of equal draws the smaller term
            out[doc[found], level] = term[found]
            drawn[found] = -np.inf
        return out

    def __call__(self, batch) -> dict:
        routes = [self.routes(flat, sizes) for flat, sizes in _slices(batch.column(1), self.kind)]
        rows = np.concatenate([np.concatenate(routes), batch.column(2).to_numpy().astype("<u4").view(">u4")[:, None]], axis=1).astype(">u4")
        width = rows.shape[1] * 4
        keys = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(rows.tobytes())])
        if self.bounds is None:
            return {"key": keys, "n": batch.column(3)}
        shard = np.searchsorted(self.bounds, rows.view(f"S{width}").ravel(), side="right")
        return {"doc_id": batch.column(0), "ids": batch.column(1), "key": keys, "shard": shard.astype(np.int32)}


def _bounds(sample: list, shards: int, width: int) -> np.ndarray:
    """Routes that cut a sample of (route, tokens) into ``shards`` ranges of about as many tokens."""
    sample.sort()
    keys, total = np.array([bytes(k) for k, _ in sample], f"S{width}"), np.cumsum([n for _, n in sample])
    return keys[np.searchsorted(total, total[-1] * np.arange(1, shards) / shards)] if sample else keys


#: Tokens whose terms are counted together.
_SLICE = 1 << 20


def _slices(column: pa.Array, kind: str):
    """Ids one after another and each document's number of them, of about ``_SLICE`` tokens at once; every document has an id."""
    width = np.dtype(kind).itemsize
    sizes = pc.binary_length(column).to_numpy().astype(np.int64)
    first = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset]
    ends = np.cumsum(sizes)
    flat = np.frombuffer(column.buffers()[2], np.uint8)[first : first + ends[-1]].view(kind)
    cuts = np.flatnonzero(np.diff(ends // (width * _SLICE), prepend=0))
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        if a < b:
            yield flat[(ends[a] - sizes[a]) // width : ends[b - 1] // width], sizes[a:b] // width


def _distinct(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (by place) and their distinct terms in order, and how often each occurs there."""
    bits = 8 * flat.dtype.itemsize
    key = np.repeat(np.arange(len(sizes), dtype=np.uint32 if bits == 16 and len(sizes) <= 1 << 16 else np.int64), sizes)
    key <<= key.dtype.type(bits)
    key |= flat
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> key.dtype.type(bits)).astype(np.int64), key.astype(flat.dtype), tf


def _weights(flat: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean: float, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (by place), their distinct terms and the BM25 weights of these."""
    doc, term, tf = _distinct(flat, sizes)
    return doc, term, (tf * (k1 + 1) / (tf + (k1 * (1 - b + b * sizes / mean))[doc]) * idf[term]).astype(np.float32)


class _Index:
    """Inverted index of one shard with BM25 weights from corpus-wide statistics."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, k1: float, b: float, query_terms: int | None = None):
        self.size = len(docs)
        doc, flat, weight = _weights(np.concatenate(docs), np.array([len(x) for x in docs]), idf, mean, k1, b)
        self.queries = []
        bounds = np.searchsorted(doc, np.arange(self.size + 1))
        for at in map(slice, bounds[:-1], bounds[1:]):  # all terms of the seed ask for its neighbours, or those that weigh most
            self.queries.append(flat[at] if query_terms is None else flat[at][np.argsort(-weight[at], kind="stable")[:query_terms]])
        order = np.argsort(flat, kind="stable")
        self.doc = doc[order]
        self.weight = weight[order].astype(np.float64)
        self.at = np.searchsorted(flat[order], np.arange(len(idf) + 1))
        # Terms of more than a quarter of the documents are rows of weights, which add up faster than postings.
        common = np.flatnonzero(np.diff(self.at) > self.size / 4)
        self.row = np.full(len(idf), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.size))
        for k, term in enumerate(common):
            at = slice(self.at[term], self.at[term + 1])
            self.rows[k, self.doc[at]] = self.weight[at]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents of the shard for the terms of one."""
        return self.asked(self.queries[seed])

    def asked(self, terms: np.ndarray) -> np.ndarray:
        """BM25 scores of all documents of the shard for distinct terms, wherever they come from."""
        query = terms.astype(np.int64)
        row = self.row[query]
        asked = np.zeros(len(self.rows))
        asked[row[row >= 0]] = 1
        rare = query[row < 0]
        first = self.at[rare]
        size = self.at[rare + 1] - first
        index = np.repeat(first - (np.cumsum(size) - size), size)
        index += np.arange(len(index))
        return asked @ self.rows + np.bincount(self.doc[index], weights=self.weight[index], minlength=self.size)

    def neighbours(self, seed: int, unused: np.ndarray, k: int) -> np.ndarray:
        """Unused documents by score, the first ``k``; ties by order in the shard, unrelated documents last."""
        left = np.flatnonzero(unused)
        return left[_best(self.scores(seed)[left], k)]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest, the largest first; ties in order."""
    at = np.arange(len(scores))
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores > cut)
        at = np.concatenate([at, np.flatnonzero(scores == cut)[: k - len(at)]])
    return at[np.lexsort((at, -scores[at]))]


def _windows(docs: list[np.ndarray], index: _Index, length: int):
    """Lists of (document, start, length) that fill one window each; the shard's last may be shorter."""
    unused = np.ones(len(docs), bool)
    window: list[tuple[int, int, int]] = []
    room, first = length, 0
    seed = 0
    unused[0] = False
    piece = (0, 0)  # document and start of what is placed next
    ranked: list[int] = []
    while True:
        doc, start = piece
        take = min(room, len(docs[doc]) - start)
        window.append((doc, start, take))
        room -= take
        rest = start + take < len(docs[doc])
        if room == 0:
            yield window
            window, room = [], length
            seed, ranked = doc, []
        if rest:
            piece = (doc, start + take)
            seed = doc if not window else seed
            continue
        ranked = [d for d in ranked if unused[d]]
        if not ranked:
            while first < len(docs) and not unused[first]:
                first += 1
            if first == len(docs):
                break
            ranked = index.neighbours(seed, unused, 24).tolist() if window else [first]
            ranked.reverse()
        doc = ranked.pop()
        unused[doc] = False
        if not window:
            seed, ranked = doc, []
        piece = (doc, 0)
    if window:
        yield window


def _powers(window: list[tuple[int, int, int]]):
    """A short window cut into windows whose lengths are powers of two, the largest first."""
    total = sum(x[2] for x in window)
    left = list(reversed(window))
    for bit in range(total.bit_length() - 1, -1, -1):
        size = total & (1 << bit)
        part = []
        while size:
            doc, start, n = left.pop()
            take = min(n, size)
            part.append((doc, start, take))
            size -= take
            if take < n:
                left.append((doc, start + take, n - take))
        if part:
            yield part


class _Search:
    """The best documents of a shard for each query; rows come shard by shard, documents before queries."""

    def __init__(self, kind: str, idf: np.ndarray, mean: float, k1: float, b: float, k: int):
        self.kind, self.settings, self.k = kind, (idf, mean, k1, b), k

    def __call__(self, batches):
        shard, index, names, rids, docs = None, None, [], [], []
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for at, asks, rid, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4)):
                if at != shard:
                    shard, index, names, rids, docs = at, None, [], [], []
                ids = np.frombuffer(ids.as_py(), self.kind)
                if not asks:
                    names.append(doc_id)
                    rids.append(rid)
                    docs.append(ids)
                    continue
                if docs and index is None:
                    index, docs = _Index(docs, *self.settings), []
                if index is not None:
                    # Sums of the same weights in another order differ in their last digits: equal texts stay ties.
                    scores = np.where(np.array(names) == doc_id, 0.0, np.round(index.asked(np.unique(ids)), 6))
                    best = _best(scores, self.k)
                    best = best[scores[best] > 0]
                    for column, values in zip(rows, ([rid] * len(best), [names[d] for d in best], [rids[d] for d in best], scores[best].tolist())):
                        column.extend(values)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.float64())], names=["rid", "neighbour_id", "neighbour_rid", "score"])


class _Pack:
    def __init__(self, length: int, shard_tokens: int, kind: str, idf: np.ndarray, mean: float, k1: float, b: float, query_terms: int | None, with_ids: bool):
        self.length, self.shard_tokens, self.kind, self.with_ids = length, shard_tokens, kind, with_ids
        self.settings = idf, mean, k1, b, query_terms

    def __call__(self, batches):
        self.next_id = TaskContext.get().partitionId() << 36
        names, docs, tokens, last = [], [], 0, None
        for batch in batches:
            for doc_id, ids, shard in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if docs and shard != last:
                    yield self.shard(names, docs)
                    names, docs, tokens = [], [], 0
                last = shard
                names.append(doc_id)
                docs.append(np.frombuffer(ids.as_py(), self.kind))
                tokens += len(docs[-1])
                if tokens >= self.shard_tokens:
                    yield self.shard(names, docs)
                    names, docs, tokens = [], [], 0
        if docs:
            yield self.shard(names, docs)

    def shard(self, names: list, docs: list[np.ndarray]) -> pa.RecordBatch:
        index = _Index(docs, *self.settings)
        rows: list[list] = [[] for _ in _PIECES.names]
        for window in _windows(docs, index, self.length):
            whole = sum(x[2] for x in window) == self.length
            for sequence in [window] if whole else _powers(window):
                offset = 0
                for doc, start, n in sequence:
                    data = docs[doc][start : start + n].astype("<u4").tobytes()
                    for column, value in zip(rows, (names[doc], start, n, zlib.crc32(data), len(docs[doc]), self.next_id, offset, data if self.with_ids else None)):
                        column.append(value)
                    offset += n
                self.next_id += 1
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(_PIECES.names, rows)], names=_PIECES.names)


class _Frequencies:
    def __init__(self, kind: str, size: int):
        self.kind, self.size = kind, size

    def __call__(self, batches):
        df = np.zeros(self.size, np.int64)
        for batch in batches:
            for flat, sizes in _slices(batch.column(0), self.kind) if batch.num_rows else ():
                df += np.bincount(_distinct(flat, sizes)[1], minlength=self.size)
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(df[terms], pa.int64())], names=["term", "df"])


def _routed(ids: DataFrame, kind: str, settings: tuple, count: int, shards: int, sample: int = 200_000) -> DataFrame:
    """``doc_id, ids, shard`` of every row, in the order of routes within a shard, all of a shard in one partition.

    Where shards begin is found on about 256 documents a shard, ``sample`` in all, chosen by their content.
    """
    tie = F.crc32(F.coalesce("doc_id", F.monotonically_increasing_id()).cast("string").cast("binary"))
    rows = ids.select("doc_id", "ids", tie.alias("tie"), "n")
    few = min(sample, 256 * shards)
    asked = rows if count <= few else rows.where(F.pmod(F.xxhash64("ids", "doc_id"), F.lit(1 << 30)) < int(few / count * (1 << 30)))
    key = T.StructField("key", T.BinaryType())
    sampled = map_batches(asked, _Route(kind, *settings), T.StructType([key, T.StructField("n", T.LongType())])).collect() if shards > 1 else []  # at most about `sample` rows
    route = _Route(kind, *settings)
    route.bounds = _bounds([(bytes(r["key"]), r["n"]) for r in sampled], shards, 4 * route.levels + 4)
    routed = map_batches(rows, route, T.StructType([*_TOKENS.fields[:2], key, T.StructField("shard", T.IntegerType())]))
    return routed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key").select("doc_id", "ids", "shard")


def _statistics(docs: DataFrame, path: str | None, end_id: int) -> tuple[DataFrame, str, tuple]:
    """Token ids of all documents, written; the kind of integers they are; rows, mean length and weight of each term."""
    spark = docs.sparkSession
    path = path or vocabulary_path()
    size = max(encoder(path).size, end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    ids = table(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _Encode(path, end_id, kind), _TOKENS), "tokens")
    ship(spark)
    count, mean = ids.agg(F.count(F.lit(1)), F.avg("n")).first()
    df = np.zeros(size, np.int64)
    for term, n in ids.select("ids").mapInArrow(by_partition(_Frequencies(kind, size)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():  # as many rows as the vocabulary has entries at most
        df[term] = n
    idf = np.log1p((count - df + 0.5) / (df + 0.5))
    return ids, kind, (count, mean, idf)


def neighbours(docs: DataFrame, queries: Column | None = None, k: int = 10, path: str | None = None, end_id: int = 1, shard_tokens: int = 4_000_000, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best BM25 neighbours among all documents, exactly: ``doc_id, place, neighbour_id, score``.

    ``queries`` is a condition on ``doc_id`` that states which rows ask; by default those whose id is divisible by 20.
    All their terms count. Documents are dealt evenly into shards of about ``shard_tokens`` tokens, every shard answers all
    queries one after another and returns its ``k`` best, of which the best stay; so work is queries times documents,
    memory a shard. Ties go to the smaller id. Documents without a common term, and those with the query's own id, are no
    neighbours. Rows without an id count in the statistics only. Null and empty texts are the end token alone.
    Repeated rows ask each for itself. An empty table has no neighbours; other columns are ignored.
    """
    ids, kind, (count, mean, idf) = _statistics(docs, path, end_id)
    shards = max(1, ceil(count * (mean or 0) / (0.75 * shard_tokens)))
    # Written, so that the numbers of rows are the same wherever they are read.
    rows = table(ids.where("doc_id is not null").select("doc_id", "ids", F.monotonically_increasing_id().alias("rid")), "numbered")
    held = rows.select(F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "rid", "doc_id", "ids")
    condition = F.col("doc_id") % 20 == 0 if queries is None else queries
    asked = rows.where(condition).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "rid", "doc_id", "ids")
    met = held.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks", "doc_id", "rid")
    found = met.mapInArrow(by_partition(_Search(kind, idf, mean or 1.0, k1, b, k)), "rid long, neighbour_id long, neighbour_rid long, score double")
    place = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "neighbour_id", "neighbour_rid"))
    best = found.withColumn("place", place).where(F.col("place") <= k)
    return best.join(rows.where(condition).select("rid", "doc_id"), "rid").select("doc_id", "place", "neighbour_id", "score")


def pack(
    docs: DataFrame,
    path: str | None = None,
    end_id: int = 1,
    length: int = 2048,
    shard_tokens: int = 4_000_000,
    query_terms: int | None = None,
    k1: float = 1.2,
    b: float = 0.75,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all rows of ``doc_id, text``; with ``with_ids`` also each piece's ids (4 bytes each, little-endian).

    Every id of every document lies in exactly one piece. A null or empty text is a document of the end token
    alone. Rows that repeat are separate documents, each packed once, also if their ids repeat or are null.
    Documents longer than a window go on in the next one. An empty table has no pieces. Other columns are ignored.
    ``shard_tokens`` bounds a task's memory (a longer document is a shard of its own); the shards cover all rows,
    which are dealt to them by content, so neighbours don't depend on how the input's files are cut.
    All terms of a seed count in the scores of its neighbours; ``query_terms`` is for those who want only the heaviest.
    """
    ids, kind, (count, mean, idf) = _statistics(docs, path, end_id)
    dealt = _routed(ids, kind, (idf, mean or 1.0, k1, b), count, max(1, ceil(count * (mean or 0) / (0.75 * shard_tokens))))
    packed = dealt.mapInArrow(by_partition(_Pack(length, shard_tokens, kind, idf, mean or 1.0, k1, b, query_terms, with_ids)), _PIECES)
    return packed if with_ids else packed.drop("ids")
