"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of characters that are not letters becomes one space; n-grams of one to
three characters are hashed into ``2**bits`` buckets. Training counts buckets by language over a bounded
sample of labelled rows and yields a matrix of log-probabilities (languages x buckets), which is broadcast.
Scoring multiplies the texts' buckets, the rows of a sparse matrix, with it, a batch at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.llm.common import by_partition, held_out, map_batches, process_state, ship

_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)
#: Characters that are worked on at once; a longer text is counted piece by piece, with overlap.
_PIECE = 1 << 20
UNKNOWN = "und"


def _letters() -> np.ndarray:
    state = process_state(__name__)
    if "letters" not in state:
        state["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
    return state["letters"]


def bucket_counts(text: str, bits: int, orders: tuple[int, ...] = (1, 2, 3)) -> tuple[np.ndarray | None, int]:
    """How often each bucket occurs in the whole text, and the number of n-grams; None if it has no letter."""
    letters, total, seen = _letters(), np.zeros(1 << bits, np.int64), False
    shift = np.uint32(32 - bits)
    carry = np.zeros(0, np.uint32)
    for at in range(0, len(text), _PIECE):
        code = np.frombuffer(text[at : at + _PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        # Beyond the table (historic scripts and symbols) a character counts as a letter if Python says so.
        alpha = letters[np.minimum(code, 0xFFFF)]
        if (far := np.flatnonzero(code > 0xFFFF)).size:
            alpha[far] = [chr(c).isalpha() for c in code[far].tolist()]
        seen |= bool(alpha.any())
        code = np.where(alpha, code, np.uint32(32))
        fresh = len(carry)
        code = np.concatenate([carry, code])
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
        fresh = int(keep[:fresh].sum())
        code = code[keep]
        for n in orders:
            start = max(0, fresh - n + 1)  # only n-grams that end in this piece
            if len(code) - start < n:
                continue
            h = np.full(len(code) - start - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ code[start + k : start + k + len(h)]) * _MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
            total += np.bincount((h * np.uint32(2654435761)) >> shift, minlength=len(total))
        carry = code[-max(orders) :]
    return (total, int(total.sum())) if seen else (None, 0)


class _Count:
    """Rows of language, bucket and count for a partition of training texts."""

    def __init__(self, bits: int):
        self.bits = bits

    def __call__(self, batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, _ = bucket_counts(text.as_py(), self.bits)
                if found is not None:
                    counts[lang] = counts[lang] + found if lang in counts else found
        for lang, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], names=["lang", "bucket", "n"])


class LanguageModel:
    """Languages in alphabetical order, and their log-probability matrix."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray, bits: int, smoothing: float):
        self.languages, self.bits = languages, bits
        p = counts + smoothing
        self.matrix = np.log(p / p.sum(axis=1, keepdims=True)).T.copy() if languages else np.zeros((1 << bits, 0))
        self.prior = np.log(documents / documents.sum()) if languages else np.zeros(0)

    def predict(self, text: str | None, evidence: int = 100) -> tuple[str, float]:
        """The likeliest language and its probability, taking a long text's n-grams for ``evidence`` independent ones."""
        names, scores = self.predict_all([text], evidence)
        return names[0], scores[0]

    def predict_all(self, texts, evidence: int = 100, most: int = 1 << 20) -> tuple[list[str], list[float]]:
        """``predict`` for many texts: their buckets are rows of a sparse matrix that is multiplied with the model's."""
        names, scores = [], []
        at, n, size, held, rows = [], [], [], 0, []

        def flush():
            nonlocal held
            if at:
                starts = np.cumsum([0] + [len(a) for a in at[:-1]])
                flat = np.concatenate(at)
                logs = np.add.reduceat(np.concatenate(n)[:, None] * self.matrix[flat], starts, axis=0)
                best = np.argmax(logs + self.prior, axis=1)
                tempered = logs * np.minimum(1.0, evidence / np.array(size))[:, None] + self.prior
                odds = np.exp(tempered - tempered.max(axis=1, keepdims=True))
                chance = odds[np.arange(len(best)), best] / odds.sum(axis=1)
                for row, b, p in zip(rows, best, chance):
                    names[row], scores[row] = self.languages[b], float(p)
            for x in (at, n, size, rows):
                x.clear()
            held = 0

        for text in texts:
            found, total = bucket_counts(text, self.bits) if text else (None, 0)
            names.append(UNKNOWN)
            scores.append(0.0)
            if found is None or not self.languages:
                continue
            filled = np.flatnonzero(found)
            at.append(filled)
            n.append(found[filled].astype(np.float64))
            size.append(total)
            rows.append(len(names) - 1)
            held += len(filled)
            if held >= most:
                flush()
        flush()
        return names, scores


def train(docs: DataFrame, usable: Column, per_language: int = 3000, bits: int = 14, smoothing: float = 0.1) -> LanguageModel:
    """Learn from rows of ``doc_id, text, lang`` for which ``usable`` holds and text and lang are not null.

    About ``per_language`` rows of each language are used (all where there are fewer), chosen by a hash of the
    id: the documented bound of the training sample. The model's size is bounded by languages x buckets.
    """
    ship(docs.sparkSession)
    rows = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    counted = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counted:
        return LanguageModel([], np.zeros((0, 1 << bits)), np.zeros(0), bits, smoothing)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counted.items()) for x in (lang, min(1.0, per_language / n))])
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(chance < share[F.col("lang")]).select("lang", "text")
    sums = sample.mapInArrow(by_partition(_Count(bits)), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    counts = np.zeros((len(languages), 1 << bits))
    counts[[languages.index(x) for x in sums["lang"]], sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return LanguageModel(languages, counts, np.array([counted[x] for x in languages], float), bits, smoothing)


class _Predict:
    def __init__(self, model, names: list[str], new: tuple[str, str]):
        self.model, self.names, self.new = model, names, new

    def __call__(self, batch) -> dict:
        model = self.model.value
        names, scores = model.predict_all(t.as_py() for t in batch.column(len(self.names)))
        return {n: batch.column(k) for k, n in enumerate(self.names)} | {self.new[0]: names, self.new[1]: scores}


def predict(rows: DataFrame, text: str, model: LanguageModel, carry: list[str], new: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``carry`` columns of ``rows`` with the language and the score (``new``) of column ``text``, a row for each row.

    Null texts and texts without a letter are ``und`` with score 0. Equal texts get equal results; of languages
    that are equally likely the first by name is taken. Columns of ``carry`` that are named like the new ones are left out.
    """
    carry = [c for c in carry if c not in new]
    schema = T.StructType([rows.schema[c] for c in carry] + [T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType())])
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return map_batches(rows.select(*carry, F.col(text).cast("string").alias("_text")), _Predict(shared, carry, new), schema)


def language_of_documents(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``documents``; learns from rows not held out.

    Null ids count as held out. A table without usable rows predicts ``und`` everywhere; an empty one is empty.
    Repeated rows stay repeated; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(docs, ~held_out(F.col("doc_id")), **settings)
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), "text", model, ["doc_id", "held_out"])
