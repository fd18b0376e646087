"""Removal of long passages that repeat anywhere, found by anchors at the positions of a difference cover.

A difference cover of a period p is a set of residues of which any two positions, wherever they are, reach one each
by the same shift below p. So if a window repeats, the two copies have an anchor (some words at a covered position) at
the same place. Only anchors at covered positions are hashed and shuffled, about a quarter of all positions; the
windows around those that repeat are then hashed whole, and a window goes if that hash starts in two places.

1. tasks emit one row for each anchor hash of a batch; positions whose hash repeats within the batch are known already;
2. hashes are sorted in their partitions and read as a stream: what occurs twice makes candidates;
3. the texts that have candidates emit the hash (95 bits) of each window around one, again once for each batch, in which
   the copies of a text stand together;
4. starts of repeated windows meet their texts, and the words they cover go.

A hash that everything shares costs a row for each batch, so no copy, however common, meets in one task.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.llm.common import by_partition, fresh, release, ship, table

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_ANCHORS = "h long, t long, span long, known boolean"
_WINDOWS = "h long, h2 int, t long, t2 long, span long, known boolean"


def difference_cover(period: int) -> list[int]:
    """The smallest set of residues, 0 and 1 among them, whose differences are all residues."""
    size = 1
    while size * (size - 1) + 1 < period:
        size += 1
    while True:
        for rest in combinations(range(2, period), max(size - 2, 0)):
            cover = [0, 1, *rest][:size]
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
        size += 1


def plan(window: int) -> tuple[int, list[int], int]:
    """Period, cover and anchor length for a window: the longest period with a perfect cover within three fifths of it."""
    period = max(p for p in (1, 3, 7, 13, 21, 31) if p <= max(1, window * 3 // 5))
    return period, difference_cover(period), window - period + 1


class _Rolling:
    """Hashes of runs of words: differences of prefix sums of word hash times power, modulo 2**64."""

    def __init__(self):
        self.powers, self.inverse = [], []
        for base in _BASES:
            self.powers.append(np.ones(1, np.uint64))
            self.inverse.append(np.ones(1, np.uint64))

    def grown(self, n: int) -> None:
        if len(self.powers[0]) < n:
            n = max(n, 2 * len(self.powers[0]))
            for k, base in enumerate(_BASES):
                for held, factor in ((self.powers, base), (self.inverse, pow(base, -1, 1 << 64))):
                    held[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, factor, np.uint64)]), dtype=np.uint64)

    def __call__(self, words: np.ndarray, at: np.ndarray, length: int, k: int) -> np.ndarray:
        """Of ``length`` words from each position on."""
        self.grown(len(words) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * self.powers[k][: len(words)], dtype=np.uint64)])
        h = (sums[at + length] - sums[at]) * self.inverse[k][at]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # bytes: the six ASCII spaces only


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Spans of window starts, both ends included, as one whole number each."""
    return (np.maximum(first, 0) << 32) | last


def _covered(spans, size: int, reach: int = 1) -> np.ndarray:
    """Which of ``size`` places are in a span, or less than ``reach`` after its end."""
    change = np.zeros(size + 1, np.int64)
    spans = np.array(spans, np.int64)
    first, last = spans >> 32, (spans & 0xFFFFFFFF) + reach
    fits = last <= size + reach - 1  # of this text, if another one has its number
    np.add.at(change, first[fits], 1)
    np.add.at(change, np.minimum(last[fits], size), -1)
    return np.cumsum(change)[:size] > 0


def _merged(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that touch joined, row by row: rows and spans. All come in order, none ends before an earlier one of its row."""
    if not len(row):
        return row, first
    opens = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)))
    return row[opens], _spans(first[opens], last[np.append(opens[1:], len(row)) - 1])


def _once(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first of each key, and of all whose key isn't alone in the batch, both in the order of the texts."""
    order = np.lexsort(keys[::-1])
    differs = np.zeros(max(len(order) - 1, 0), bool)
    for key in keys:
        differs |= key[order][1:] != key[order][:-1]
    first = np.flatnonzero(np.append(True, differs)) if len(order) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(order)))
    return np.sort(order[first]), np.sort(order[np.repeat(count > 1, count)])


class _Anchors:
    """One row for each anchor hash of a batch, with the window starts around it; what repeats in the batch is known."""

    owner = __name__

    def __init__(self, window: int):
        self.window, (self.period, cover, self.length) = window, plan(window)
        self.covered = np.zeros(self.period, bool)
        self.covered[cover] = True

    def __call__(self, batches):
        rolling = _Rolling()
        for batch in batches:
            rid = batch.column(0).to_numpy()
            hashes, rows, positions = [], [], []
            for row, text in enumerate(batch.column(1)):
                words = _words(text.as_py())
                if len(words) >= self.window:
                    at = np.arange(len(words) - self.length + 1)
                    at = at[self.covered[at % self.period]]
                    hashes.append(rolling(_hashed(words), at, self.length, 0))
                    rows.append(np.full(len(at), row))
                    positions.append(at)
            if hashes:
                h, row, at = (np.concatenate(x) for x in (hashes, rows, positions))
                first, again = _once([h])
                before = at - self.period + 1  # a window that starts so far before an anchor holds all of it
                yield _batch(_ANCHORS, [h[first].view(np.int64), rid[row[first]], _spans(before[first], at[first]), np.zeros(len(first), bool)])
                row, spans = _merged(row[again], before[again], at[again])
                yield _batch(_ANCHORS, [rid[row], rid[row], spans, np.ones(len(row), bool)])


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


class _Repeated:
    """Of rows sorted by key, the spans of those whose key comes again; spans that are known pass as they are."""

    owner = __name__

    def __init__(self, keys: list[str], ids: list[str]):
        self.keys, self.out = keys, [*ids, "span"]

    def __call__(self, batches):
        held = None  # the last key and row, and whether the row has gone out
        for batch in batches:
            yield batch.filter(batch.column("known")).select(self.out)
            batch = batch.filter(pa.array(~batch.column("known").to_numpy(zero_copy_only=False)))
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(n).to_numpy() for n in self.keys])
            again = np.append(held is not None and bool((held[0] == keys[0]).all()), (keys[1:] == keys[:-1]).all(axis=1))
            if again[0] and not held[2]:
                yield held[1].select(self.out)
            keep = again | np.append(again[1:], False)
            held = (keys[-1], batch.slice(batch.num_rows - 1), bool(keep[-1]))
            yield batch.filter(pa.array(keep)).select(self.out)


class _Windows:
    """A row for each window in the spans of a text, once for each hash of a batch; what repeats in the batch is known."""

    owner = __name__

    def __init__(self, window: int):
        self.window = window

    def __call__(self, batches):
        rolling = _Rolling()
        for batch in batches:
            ids = [batch.column(k).to_numpy() for k in (0, 1)]
            one, two, rows, positions = [], [], [], []
            for row, (text, spans) in enumerate(zip(batch.column(2), batch.column(3))):
                words = _hashed(_words(text.as_py()))
                at = np.flatnonzero(_covered(spans.as_py(), len(words))[: max(len(words) - self.window + 1, 0)])
                one.append(rolling(words, at, self.window, 0))
                two.append(rolling(words, at, self.window, 1) >> np.uint64(33))
                rows.append(np.full(len(at), row))
                positions.append(at)
            if one:
                h, h2, row, at = (np.concatenate(x) for x in (one, two, rows, positions))
                first, again = _once([h, h2])
                yield _batch(_WINDOWS, [h[first].view(np.int64), h2[first].astype(np.int32), *[x[row[first]] for x in ids], _spans(at[first], at[first]), np.zeros(len(first), bool)])
                row, spans = _merged(row[again], at[again], at[again])
                yield _batch(_WINDOWS, [ids[0][row], np.zeros(len(row), np.int32), *[x[row] for x in ids], spans, np.ones(len(row), bool)])


class _Cut:
    """``n_words, n_removed, kept_text`` or its digest, of a text and the starts of its repeated windows."""

    owner = __name__

    def __init__(self, window: int, digest: bool):
        self.window, self.digest = window, digest

    def __call__(self, batches):
        for batch in batches:
            size, gone, out = [], [], []
            for text, spans in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                words = _words(text.as_py())
                size.append(len(words))
                spans = spans.as_py()
                if spans:
                    words = [words[k] for k in np.flatnonzero(~_covered(spans, len(words), self.window))]
                gone.append(size[-1] - len(words))
                said = b" ".join(words)
                out.append(hashlib.sha256(said).hexdigest() if self.digest else said.decode("utf-8", "replace"))
            columns = [batch.column(k) for k in range(batch.num_columns - 2)]
            names = batch.schema.names[: len(columns)] + ["n_words", "n_removed", "kept_sha256" if self.digest else "kept_text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], names=names)


def without_repeats(docs: DataFrame, window: int = 35, text: str = "text", digest: bool = False, partitions: int | None = None) -> DataFrame:
    """All columns of ``docs`` but ``text``, with ``n_words``, ``n_removed`` and ``kept_text`` (or ``kept_sha256``).

    A word goes if a run of ``window`` words around it also starts anywhere else, in this text or another; all copies
    go, none is kept. Words are what ASCII spaces part, unchanged; the kept ones are joined by one space. A null text
    has no words. Repeated rows (ids included) are texts of their own, so they remove each other. Ids may be null.
    Columns that are named like the new ones are replaced. ``partitions`` deals the hashes, by default the session's.
    """
    spark = docs.sparkSession
    ship(spark)
    new = ["n_words", "n_removed", "kept_sha256" if digest else "kept_text"]
    taken = [c for c in docs.columns if c not in (*new, text)]
    dealt = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.col(text).cast("binary")
    # What is removed depends on the text alone, so its hash is its number: copies meet in one task's batches, where
    # their windows are hashed once. The second hash tells texts apart that share the first one.
    t: Column = F.xxhash64(text)
    t2 = F.xxhash64(F.lit(window), text)
    hashed = docs.select(t.alias("t"), body.alias("_text")).mapInArrow(by_partition(_Anchors(window)), _ANCHORS)
    met = hashed.repartition(dealt, "h").sortWithinPartitions("h").mapInArrow(by_partition(_Repeated(["h"], ["t"])), "t long, span long")
    candidates = table(met.groupBy("t").agg(F.collect_set("span").alias("spans")), "anchors")  # of one text
    release(spark)  # the shuffled hashes are not read again
    around = docs.select(t.alias("t"), t2.alias("t2"), body.alias("_text")).join(candidates, "t").select("t", "t2", "_text", "spans")
    hashed = around.mapInArrow(by_partition(_Windows(window)), _WINDOWS)
    again = hashed.repartition(dealt, "h", "h2").sortWithinPartitions("h", "h2").mapInArrow(by_partition(_Repeated(["h", "h2"], ["t", "t2"])), "t long, t2 long, span long")
    a, b, c, d = (fresh(docs.columns, n) for n in ("_t", "_second", "_text", "_spans"))
    starts = table(again.groupBy("t", "t2").agg(F.collect_set("span").alias(d)), "starts").withColumnsRenamed({"t": a, "t2": b})
    release(spark)
    rows = docs.withColumns({a: t, b: t2}).join(starts, [a, b], "left")
    kinds = T.StructType([*[docs.schema[x] for x in taken], T.StructField(new[0], T.LongType()), T.StructField(new[1], T.LongType()), T.StructField(new[2], T.StringType())])
    return rows.select(*taken, body.alias(c), d).mapInArrow(by_partition(_Cut(window, digest)), kinds)
