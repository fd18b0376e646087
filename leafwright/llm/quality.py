"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words and runs of punctuation are tokens, with their case; a token equal to the one before is coded as a
repetition. Hashed unigrams and bigrams with logarithmic counts, scaled to length one, are the features.
Training is sequential FTRL-proximal over a bounded sample of labelled rows in one task; the weights (their
number is fixed) are broadcast and scoring is a sparse dot product.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.llm.common import Recent, by_partition, held_out, map_batches, process_state, ship

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_REPEATED = np.uint32(0x5EED5EED)
_CACHE = 300_000


def _chunk(chunk: str, cache: Recent) -> bytes:
    found = cache.find(chunk)
    if found is None:
        found = np.array([zlib.crc32(t.encode("utf-8", "replace")) for t in _TOKEN.findall(chunk)], np.uint32).tobytes()
        if len(chunk) <= 64:
            cache.keep(chunk, found)
    return found


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in rising order and their values, of the whole text; none for a text without tokens."""
    state = process_state(__name__)
    cache = state.get("token hashes")
    if cache is None:
        cache = state["token hashes"] = Recent(_CACHE)
    chunks = (text or "").split()
    known = list(map(cache.get, chunks))
    if None in known:
        known = [_chunk(c, cache) if k is None else k for c, k in zip(chunks, known)]
    h = np.frombuffer(b"".join(known), np.uint32).copy()
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0)
    same = h[1:] == h[:-1]
    h[1:][same] = _REPEATED
    pairs = (h[:-1] * np.uint32(2654435761)) ^ (h[1:] * np.uint32(2246822519)) ^ np.uint32(0xB16B00B5)
    buckets, counts = np.unique((np.concatenate([h, pairs]) * np.uint32(3266489917)) >> np.uint32(32 - bits), return_counts=True)
    values = np.log1p(counts)
    return buckets.astype(np.int64), values / np.sqrt((values * values).sum())


class _Features:
    def __init__(self, bits: int):
        self.bits = bits

    def __call__(self, batch) -> dict:
        found = [features(t.as_py(), self.bits) for t in batch.column(2)]
        return {
            "place": batch.column(0), "label": batch.column(1),
            "buckets": pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()),
            "x": pa.array([f[1].astype(np.float32).tobytes() for f in found], pa.binary()),
        }


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes over the rows in their order."""
    size = (1 << bits) + 1  # the last weight is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weight(at):
        za = z[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weight(np.arange(size))
    return w[:-1], float(w[-1])


class _Train:
    def __init__(self, bits: int, **settings):
        self.bits, self.settings = bits, settings

    def __call__(self, batches):
        rows = [(p, b, x, y) for batch in batches for p, y, b, x in zip(*(c.to_pylist() for c in batch.columns))]
        rows.sort()
        weights, bias = ftrl([(np.frombuffer(b, np.int32), np.frombuffer(x, np.float32).astype(float), y) for _, b, x, y in rows], self.bits, **self.settings)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f8").tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"])


class QualityModel:
    def __init__(self, weights: np.ndarray, bias: float, bits: int):
        self.weights, self.bias, self.bits = weights, bias, bits

    def score(self, text: str | None) -> float:
        at, x = features(text, self.bits)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at] @ x, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, rows: int = 12_000, bits: int = 18, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.005, l2: float = 0.005, epochs: int = 5) -> QualityModel:
    """Learn from ``labels`` (doc_id, label 0 or 1; not null) and the texts of ``docs`` with the same id.

    ``rows`` bounds the labelled rows that are used; beyond it those with the least hash of the id are taken.
    Without labelled rows every text gets one half.
    """
    ship(docs.sparkSession)
    place = F.xxhash64(F.col("doc_id"), F.lit(2))
    chosen = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"), place.alias("place")).dropDuplicates(["doc_id", "label"]).orderBy("place", "label").limit(rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("place", "label", "text")  # `rows` rows at most are broadcast
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("buckets", T.BinaryType()), T.StructField("x", T.BinaryType())])
    model = map_batches(labelled, _Features(bits), schema).repartition(1).mapInArrow(by_partition(_Train(bits, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)), "weights binary, bias double").first()
    if model is None:
        return QualityModel(np.zeros(1 << bits), 0.0, bits)
    return QualityModel(np.frombuffer(bytes(model["weights"]), "<f8"), model["bias"], bits)


class _Score:
    def __init__(self, model, names: list[str], new: str):
        self.model, self.names, self.new = model, names, new

    def __call__(self, batch) -> dict:
        model = self.model.value
        return {n: batch.column(k) for k, n in enumerate(self.names)} | {self.new: np.array([model.score(t.as_py()) for t in batch.column(len(self.names))])}


def score(rows: DataFrame, text: str, model: QualityModel, carry: list[str], new: str = "score") -> DataFrame:
    """``carry`` columns of ``rows`` (but one named ``new``) with the score of column ``text``; null and empty texts get the bias alone."""
    carry = [c for c in carry if c != new]
    schema = T.StructType([rows.schema[c] for c in carry] + [T.StructField(new, T.DoubleType())])
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return map_batches(rows.select(*carry, F.col(text).cast("string").alias("_text")), _Score(shared, carry, new), schema)


def quality_of_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``; labels of held-out ids aren't used.

    Null ids count as held out. Repeated rows stay repeated, an empty table gives an empty result, further
    columns are ignored; equal texts get equal scores.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(~held_out(F.col("doc_id")))
    model = train(docs, known, **settings)
    scored = score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), "text", model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
