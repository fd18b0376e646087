"""Masked pseudo-likelihood: a bidirectional window network scores every token of a document.

Words of all documents are counted; the most frequent ones and hash buckets for the others are the vocabulary,
in classes of equal size. The network sees the two tokens on each side of a masked one, adds their embeddings,
weighted by place, through a tanh layer, and predicts the masked token's class and the token within its class.

Training is data-parallel over all documents. They are dealt by a hash of id and tokens; how many deals there are
follows from the number of tokens alone, so neither files nor tasks change the result. Each deal starts from the
same parameters (the corpus unigram distribution in the output biases), runs Adagrad over its documents, in which
every token is masked once, and gives its parameters; these are averaged by number of targets in an aggregation by
parameter row. A document's score is the sum of the conditional log-probabilities of all its tokens.

The network tells the words of a hash bucket apart by nothing but their own counts: such a word's probability is
that of its bucket times its share of the bucket's count. Words are counted in full and the shares reach the
documents by a join, so neither a task nor the driver ever holds all words. A document asks once for each of its
words in buckets; such a word occurs no more often than any of the known ones, so no key of that join is hot.
"""

from __future__ import annotations

import zlib
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.llm.common import by_partition, map_batches, ship, table

_TRAILING = r"(\pL)([.,!?;:]+)(\s|$)"
#: Characters whose words are looked up together.
_PIECE = 1 << 24


def _pieces(column: pa.Array):
    """Slices of a text column of bounded size."""
    length = np.append(pc.fill_null(pc.binary_length(column), 0).to_numpy(), 0)
    at, held = 0, 0
    for k in range(len(column)):
        held += length[k]
        if held >= _PIECE or k == len(column) - 1:
            yield column.slice(at, k + 1 - at)
            at, held = k + 1, 0


def _words(column: pa.Array) -> pa.ListArray:
    """Lower-case words of each text; punctuation at a word's end is a word. Empty strings may occur."""
    return pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), _TRAILING, r"\1 \2\3"))


def _bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of strings without nulls, faster than by their scalars."""
    column = column.cast(pa.binary())
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(column.buffers()[2] or b"").tobytes()
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


class _Count:
    def __call__(self, batches):
        for batch in batches:
            for part in _pieces(batch.column(0)):
                counts = _words(part).flatten().value_counts()
                yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts").cast(pa.int64())], names=["word", "n"])


class _Encode:
    """Token numbers of each text as unsigned 16-bit integers, the hashes of its words in buckets, and how often each occurs."""

    def __init__(self, vocabulary, buckets: int):
        self.vocabulary, self.buckets = vocabulary, buckets

    def __call__(self, batch) -> dict:
        known = self.vocabulary.value
        first, known = len(known), pa.array(list(known), pa.string())  # in the order of their numbers
        out, hashes, times, held = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for part in _pieces(batch.column(1)):
            lists = _words(part)
            coded = lists.flatten().dictionary_encode()
            names, at = coded.dictionary, coded.indices.to_numpy()
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            number = pc.fill_null(pc.index_in(names, known), -1).to_numpy().astype(np.int64)
            number[pc.equal(names, "").to_numpy(zero_copy_only=False)] = -2
            own = np.zeros(len(number), np.int64)
            if (rare := np.flatnonzero(number == -1)).size:
                said = _bytes(names.take(pa.array(rare)))
                number[rare] = first + np.fromiter(map(zlib.crc32, said), np.int64, len(said)) % self.buckets
                own[rare] = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in said), np.uint64, len(said)).view(np.int64)  # as Spark's xxhash64
            ids = number[at]
            hashed = ids >= first
            rows = np.repeat(np.arange(len(part)), np.diff(ends))[hashed]
            pairs, n = np.unique(rows * len(number) + at[hashed], return_counts=True)  # a text's distinct words
            text, word = np.divmod(pairs, max(1, len(number)))
            hashes.append(own[word])
            times.append(n)
            held.append(held[-1][-1] + np.cumsum(np.bincount(text, minlength=len(part))))
            keep = ids >= 0
            bounds = np.concatenate([[0], np.cumsum(keep)])[ends]
            ids = ids[keep].astype("<u2")
            out += [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        bounds = pa.array(np.concatenate(held), pa.int32())
        hashed, times = (pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x))) for x in (hashes, times))
        return {"doc_id": batch.column(0), "rid": batch.column(2), "ids": pa.array(out, pa.binary()), "hashed": hashed, "times": times}


class Network:
    """Parameters as one matrix of ``dims`` + 1 columns: embeddings, places, hidden bias, classes, tokens (the last column: output biases)."""

    def __init__(self, classes: int, size: int, dims: int, window: int):
        self.classes, self.size, self.dims, self.window = classes, size, dims, window
        self.tokens = classes * size
        n = self.tokens
        self.parts = {}
        at = 0
        for name, rows in (("embedding", n + 1), ("place", 2 * window), ("hidden", 1), ("class", classes), ("token", n)):
            self.parts[name] = slice(at, at + rows)
            at += rows
        self.rows = at
        self.offsets = (*range(-window, 0), *range(1, window + 1))
        self.rooms: dict[str, np.ndarray] = {}

    def room(self, name: str, like: np.ndarray, *shape: int) -> np.ndarray:
        """An array to write a step's values into, used again by the next step: fresh pages cost as much as the sums."""
        held = self.rooms.get(name)
        if held is None or len(held) < shape[0] or held.shape[1:] != shape[1:] or held.dtype != like.dtype:
            held = self.rooms[name] = np.empty(shape, like.dtype)
        return held[: shape[0]]

    def start(self, counts: np.ndarray, seed: int = 11) -> np.ndarray:
        """Small random embeddings; output biases give the smoothed unigram distribution."""
        w = np.zeros((self.rows, self.dims + 1), np.float32)
        w[self.parts["embedding"], : self.dims] = np.random.default_rng(seed).normal(0, 0.3, (self.tokens + 1, self.dims))
        w[self.parts["embedding"].stop - 1] = 0  # beyond a document's ends
        w[self.parts["place"], : self.dims] = 1
        w[self.parts["token"], : self.dims] = 0
        p = (counts + 1.0).reshape(self.classes, self.size)
        w[self.parts["class"], self.dims] = np.log(p.sum(axis=1) / p.sum())
        w[self.parts["token"], self.dims] = np.log(p / p.sum(axis=1, keepdims=True)).reshape(-1)
        return w

    def line(self, documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of whole documents as one line with room for a window between them, and where they stand in it."""
        k = self.window
        size = np.array([len(d) for d in documents], np.int64)
        line = np.full(size.sum() + k * (len(size) + 1), self.tokens, np.int64)
        at = np.arange(size.sum()) + np.repeat(k * np.arange(1, len(size) + 1), size)
        line[at] = np.concatenate(documents)
        return line, at

    def contexts(self, documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Targets and the tokens around each, of whole documents."""
        line, at = self.line(documents)
        return line[at], np.stack([line[at + o] for o in self.offsets], axis=1)

    def windows(self, target: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Single targets, each between the tokens around it, as a line."""
        k = self.window
        return np.column_stack([context[:, :k], target, context[:, k:]]).reshape(-1), np.arange(len(target)) * (2 * k + 1) + k

    def parted(self, line: np.ndarray, at: np.ndarray, most: int):
        """At most so many targets at once, each with its whole window."""
        k = self.window
        for first in range(0, len(at), most):
            here = at[first : first + most]
            yield line[here[0] - k : here[-1] + k + 1], here - (here[0] - k)

    def spread(self, w: np.ndarray) -> np.ndarray:
        """Weights of the places, each row 16 times side by side, for products with long rows."""
        return np.tile(w[self.parts["place"], : self.dims], 16)

    def shifted(self, name: str, values: np.ndarray, spread: np.ndarray, offsets) -> np.ndarray:
        """For each row the sum of the rows at ``offsets`` from it, weighted by place; rows near the ends are not sums."""
        k, d, n = self.window, self.dims, len(values)
        wide = -(-n // 16)
        flat = values.reshape(-1)
        total, product = (self.room(x, values, wide + 1, 16 * d) for x in (name, "product"))
        total[:] = 0
        inner = total.reshape(-1)[k * d : (n - k) * d]
        rows, rest = divmod(len(inner), 16 * d)
        for j, o in enumerate(offsets):
            part = flat[(k + o) * d : (n - k + o) * d]
            np.multiply(part[: rows * 16 * d].reshape(rows, 16 * d), spread[j], out=product[:rows])
            np.multiply(part[rows * 16 * d :], spread[j, :rest], out=product[rows, :rest])
            inner += product.reshape(-1)[: len(inner)]
        return total.reshape(-1)[: n * d].reshape(n, d)

    def around(self, w: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The embeddings of a line's tokens."""
        out = self.room("around", w, len(line), self.dims)
        return np.take(np.ascontiguousarray(w[self.parts["embedding"], : self.dims]), line, axis=0, out=out, mode="clip")

    def hidden(self, w: np.ndarray, around: np.ndarray, at: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """What the network makes of the tokens around each target, and a last column of ones."""
        d = self.dims
        total = np.take(self.shifted("total", around, spread, self.offsets), at, axis=0, out=self.room("hidden", w, len(at), d), mode="clip")
        total += w[self.parts["hidden"], :d]
        one = self.room("one", w, len(at), d + 1)
        one[:, :d], one[:, d] = np.tanh(total, out=total), 1
        return one

    def large(self, w: np.ndarray) -> bool:
        """Whether logits can be beyond what single precision takes to the exponent; no hidden value is beyond 1."""
        outputs = w[self.parts["class"].start :]
        return bool((np.abs(outputs, out=self.room("outputs", w, *outputs.shape)) @ np.ones(self.dims + 1, w.dtype)).max() > 60)

    @staticmethod
    def _exp(z: np.ndarray, large: bool) -> np.ndarray:
        """Logits become probabilities but for a factor of each row; gives the rows' sums."""
        if large:
            z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        return z @ np.ones(z.shape[1], z.dtype)

    @classmethod
    def _log_softmax(cls, z: np.ndarray, at: np.ndarray, large: bool) -> np.ndarray:
        if large:
            z -= z.max(axis=1, keepdims=True)
        chosen = z[np.arange(len(z)), at]
        return chosen - np.log(cls._exp(z, False))

    @staticmethod
    def by_token(line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of targets by token and so by class, and where they stand in that order."""
        order = np.argsort(line[at].astype(np.uint16), kind="stable")
        return order, at[order]

    def runs(self, target: np.ndarray) -> list[tuple[int, int, int]]:
        """The slice of each class that occurs among sorted targets."""
        bounds = np.searchsorted(target, np.arange(self.classes + 1) * self.size)
        found = np.flatnonzero(bounds[1:] > bounds[:-1])
        return list(zip(found.tolist(), bounds[found].tolist(), bounds[found + 1].tolist()))

    def log_probabilities(self, w: np.ndarray, target: np.ndarray, context: np.ndarray) -> np.ndarray:
        return self.likelihoods(w, *self.windows(target, context), self.spread(w), self.large(w))

    def likelihoods(self, w: np.ndarray, line: np.ndarray, at: np.ndarray, spread: np.ndarray, large: bool) -> np.ndarray:
        """Log-probabilities of the targets at ``at``."""
        order, at = self.by_token(line, at)
        target, n = line[at], len(at)
        one = self.hidden(w, self.around(w, line), at, spread)
        top, low = w[self.parts["class"]], w[self.parts["token"]]
        said = self._log_softmax(np.matmul(one, top.T, out=self.room("first", w, n, self.classes)), target // self.size, large)
        second = self.room("second", w, n, self.size)
        for c, a, b in self.runs(target):
            np.matmul(one[a:b], low[c * self.size : (c + 1) * self.size].T, out=second[a:b])
        said += self._log_softmax(second, target % self.size, large)
        out = np.empty_like(said)
        out[order] = said
        return out

    def step(self, w: np.ndarray, memory: np.ndarray, target: np.ndarray, context: np.ndarray, rate: float) -> None:
        """One Adagrad step on the mean log-probability of the targets."""
        self.learn(w, memory, *self.windows(target, context), rate)

    def learn(self, w: np.ndarray, memory: np.ndarray, line: np.ndarray, at: np.ndarray, rate: float) -> None:
        """The same for the targets at ``at``."""
        d, n, k = self.dims, len(at), self.window
        at = self.by_token(line, at)[1]
        target, large, spread = line[at], self.large(w), self.spread(w)
        around = self.around(w, line)
        one = self.hidden(w, around, at, spread)
        g = self.room("gradient", w, *w.shape)
        g[:] = 0
        top, low, down = w[self.parts["class"]], w[self.parts["token"]], g[self.parts["token"]]
        known, scaled = np.arange(n), self.room("scaled", w, n, d + 1)
        # Rows of p and q are probabilities times the row's sum, which the narrow factors are divided by.
        p = np.matmul(one, top.T, out=self.room("first", w, n, self.classes))
        total = self._exp(p, large)
        p[known, target // self.size] -= total
        total = 1 / total[:, None]
        np.matmul(p.T, np.multiply(one, total, out=scaled), out=g[self.parts["class"]])
        back = np.matmul(p, np.ascontiguousarray(top[:, :d]), out=self.room("back", w, n, d))
        back *= total
        runs, q, pushed = self.runs(target), self.room("second", w, n, self.size), self.room("pushed", w, n, d)
        for c, a, b in runs:
            np.matmul(one[a:b], low[c * self.size : (c + 1) * self.size].T, out=q[a:b])
        total = self._exp(q, large)
        q[known, target % self.size] -= total
        total = 1 / total[:, None]
        np.multiply(one, total, out=scaled)
        for c, a, b in runs:
            own = slice(c * self.size, (c + 1) * self.size)
            np.matmul(q[a:b].T, scaled[a:b], out=down[own])
            np.matmul(q[a:b], low[own, :d], out=pushed[a:b])
        pushed *= total
        back += pushed
        h = one[:, :d]
        np.subtract(1, np.multiply(h, h, out=pushed), out=pushed)
        back *= pushed
        g[self.parts["hidden"], :d] = np.ones(n, w.dtype) @ back
        # What each target sends to the tokens around it is added up by place in the line, then by token.
        sent = self.room("sent", w, len(line) + 2 * k, d)
        sent[:] = 0
        sent[at + k] = back
        inner, ones = sent[2 * k : len(line)], np.ones(len(line) - 2 * k, w.dtype)
        product = self.room("by place", w, len(inner), d)
        for j, o in enumerate(self.offsets):
            g[self.parts["place"].start + j, :d] = ones @ np.multiply(around[k + o : len(line) - k + o], inner, out=product)
        pull = self.shifted("total", sent, spread, [-o for o in self.offsets])[k : k + len(line)]
        for j in range(d):  # the last token stands for what is beyond a document's ends
            g[: self.tokens, j] = np.bincount(line, weights=pull[:, j], minlength=self.tokens + 1)[: self.tokens]
        g /= n
        square = self.room("square", w, *w.shape)
        memory += np.multiply(g, g, out=square)
        np.sqrt(np.add(memory, 1e-8, out=square), out=square)
        g *= rate
        w -= np.divide(g, square, out=g)


class _Train:
    """Parameter rows of each deal's own network times its number of targets; rows come deal by deal."""

    def __init__(self, network: Network, start, batch: int, rate: float):
        self.network, self.start, self.batch, self.rate = network, start, batch, rate

    def __call__(self, batches):
        deal, held, size = None, [], 0
        for rows in batches:
            for number, ids in zip(rows.column(0).to_pylist(), rows.column(1)):
                if number != deal or size >= 1 << 20:  # documents of about a million tokens at once
                    if deal is not None:
                        self.learn(held)
                        held, size = [], 0
                if number != deal:
                    yield from self.done() if deal is not None else ()
                    deal, self.w, self.seen = number, self.start.value.copy(), 0
                    self.memory = np.full_like(self.w, 1e-6)
                held.append(np.frombuffer(ids.as_py(), "<u2"))
                size += len(held[-1])
        if deal is not None:
            self.learn(held)
            yield from self.done()

    def learn(self, documents: list[np.ndarray]) -> None:
        line, at = self.network.line(documents)
        for part, here in self.network.parted(line, at, self.batch):
            self.network.learn(self.w, self.memory, part, here, self.rate)
        self.seen += len(at)

    def done(self):
        w, seen = self.w, self.seen
        if seen:
            values = [pa.array(w[:, k].astype(np.float64) * seen) for k in range(w.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w)), pa.int64()), pa.array(np.full(len(w), float(seen))), *values], names=["row", "targets", *[f"w{k}" for k in range(w.shape[1])]])


class _Score:
    def __init__(self, network: Network, weights):
        self.network, self.weights = network, weights

    def __call__(self, batch) -> dict:
        ids = [np.frombuffer(x, "<u2") for x in batch.column(1).to_pylist()]
        net, w = self.network, self.weights.value
        spread, large = net.spread(w), net.large(w)
        total, size = np.zeros(len(ids)), np.array([len(x) for x in ids], np.int64)
        at = 0
        while at < len(ids):
            end, held = at, 0
            while end < len(ids) and held < 1 << 16:
                held += len(ids[end])
                end += 1
            doc, said = np.repeat(np.arange(end - at), size[at:end]), [np.zeros(0)]
            said += [net.likelihoods(w, line, here, spread, large) for line, here in net.parted(*net.line(ids[at:end]), 1 << 13)]
            total[at:end] = np.bincount(doc, weights=np.concatenate(said), minlength=end - at)
            at = end
        return {"doc_id": batch.column(0), "n_tokens": size, "total": total, "rid": batch.column(2)}


def score(docs: DataFrame, classes: int = 64, size: int = 64, buckets: int = 1024, dims: int = 16, window: int = 2, batch: int = 8192, rate: float = 0.2, deal_tokens: int = 1 << 22) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_likelihood`` for every row of ``doc_id, text``.

    ``classes`` x ``size`` is the network's vocabulary, of which ``buckets`` are hash buckets of rarer words, each
    scored with its share of the bucket's count (words are told apart by 64 bits of their hash). Every token of every
    document is a target in training, and scores are of all tokens of the whole text. A network is trained for about
    every ``deal_tokens`` tokens.
    Null and empty texts have no tokens, sum 0 and mean null. Repeated rows are counted and scored each; an
    empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    network = Network(classes, size, dims, window)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = table(docs.select("text").mapInArrow(by_partition(_Count()), "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = [(r["word"], r["n"]) for r in counted.orderBy(F.desc("n"), "word").limit(network.tokens - buckets).collect()]  # a vocabulary
    known = {w: k for k, (w, _) in enumerate(top)}
    counts = np.zeros(network.tokens)
    counts[: len(top)] = [n for _, n in top]
    bucket = F.crc32(F.col("word").cast("binary")) % buckets
    for r in counted.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect():  # `buckets` rows
        counts[len(top) + r["bucket"]] = r["n"]
    for w, n in top:  # frequent words have left their buckets
        counts[len(top) + zlib.crc32(w.encode()) % buckets] -= n
    encoded = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("rid", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("hashed", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])
    ids = table(map_batches(docs.withColumn("rid", F.monotonically_increasing_id()), _Encode(sc.broadcast(known), buckets), encoded), "tokens")
    start = network.start(counts)
    columns = [f"w{k}" for k in range(dims + 1)]
    deals = max(1, ceil(counts.sum() / deal_tokens))
    place = F.xxhash64("doc_id", "ids")
    dealt = ids.select(F.pmod(place, F.lit(deals)).cast("int").alias("deal"), "ids", place.alias("place"), "doc_id")
    dealt = dealt.repartitionById(deals, F.col("deal")).sortWithinPartitions("deal", "place", "doc_id").select("deal", "ids")
    trained = dealt.mapInArrow(by_partition(_Train(network, sc.broadcast(start), batch, rate)), "row long, targets double, " + ", ".join(f"{c} double" for c in columns))
    averaged = trained.groupBy("row").agg(*[(F.sum(c) / F.sum("targets")).alias(c) for c in columns]).toPandas()  # the network's rows
    weights = start.copy()
    if len(averaged):
        weights[averaged["row"].to_numpy()] = averaged[columns].to_numpy(np.float32)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("rid", T.LongType())])
    scored = map_batches(ids.select("doc_id", "ids", "rid"), _Score(network, sc.broadcast(weights)), schema)
    within = F.log(F.col("n") / F.get(F.lit(counts[len(top) : len(top) + buckets].tolist()), bucket.cast("int")))
    shares = counted.where(~F.col("word").isin(list(known))).select(F.xxhash64("word").alias("hash"), within.alias("share"))
    shares = shares.groupBy("hash").agg(F.max("share").alias("share"))  # one row also where hashes clash
    asked = ids.select("rid", F.explode(F.arrays_zip("hashed", "times")).alias("x")).select("rid", F.col("x.hashed").alias("hash"), F.col("x.times").alias("times"))
    of_words = asked.join(shares.hint("merge"), "hash").groupBy("rid").agg(F.sum(F.col("share") * F.col("times")).alias("shares"))
    total = F.col("total") + F.coalesce("shares", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, F.round(total / F.col("n_tokens"), 4))
    return scored.join(of_words.hint("merge"), "rid", "left").select("doc_id", "n_tokens", F.round(total, 2).alias("log_likelihood"), mean.alias("mean_log_likelihood"))
