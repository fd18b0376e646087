"""Running sums over sorted rows that no task holds whole: one pass within range partitions, then what came before them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from leafwright.scratch import table
from leafwright.shipping import ship


def segments(columns: list[pa.Array]) -> np.ndarray:
    """Where a new combination of values begins, in rows that have equal ones together; nulls are equal."""
    size = len(columns[0])
    opens = np.zeros(size, bool)
    opens[:1] = True
    for c in columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        opens[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(opens)


class _Local:
    """Adds to each batch the sums within this partition, from the first row of a key on; the last key's sums are carried along."""

    def __init__(self, keys: list[str], sums: list[str], local: list[str]):
        self.keys, self.sums, self.local = keys, sums, local

    def __call__(self, batches):
        last, carry = None, np.zeros(len(self.sums), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = segments([batch.column(k) for k in self.keys])
            first = [batch.column(k)[0].as_py() for k in self.keys]
            if last is None or first != last:
                carry[:] = 0
            columns = []
            for n, name in enumerate(self.sums):
                whole = np.cumsum(batch.column(name).to_numpy())
                base = np.where(at > 0, whole[at - 1], 0)
                base[0] -= carry[n]
                columns.append(whole - np.repeat(base, np.diff(np.append(at, batch.num_rows))))
                carry[n] = columns[-1][-1]
            last = [batch.column(k)[batch.num_rows - 1].as_py() for k in self.keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns)], names=[*batch.schema.names, *self.local])


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` sorted over all partitions, with the number of theirs as ``part``."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], also: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with the running sum of each of ``sums`` (whole numbers) over the rows of a key so far, this one included.

    ``also`` names further columns, which ``sums`` may use. The rows are dealt by ranges of ``keys`` and ``order``, so
    a key of any size is shared by many tasks; what a key has in earlier partitions is summed from one row for each
    partition of it, and joined back. Null keys are one key. The rows are written once (this runs a job).
    """
    ship(rows.sparkSession)
    dealt = ranged(rows, [*keys, *order]).withColumns(also or {}).withColumns({k: c.cast("long") for k, c in sums.items()})
    names = list(sums)
    local, carried = [f"_local_{n}" for n in names], [f"_carried_{n}" for n in names]
    schema = T.StructType([*dealt.schema.fields, *[T.StructField(n, T.LongType()) for n in local]])
    held = table(dealt.mapInArrow(_Local(keys, names, local), schema), "scan")
    before = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    totals = held.groupBy("part", *keys).agg(*[F.sum(n).alias(n) for n in names])
    carries = totals.select(F.col("part").alias("_part"), *[F.col(k).alias(f"_key_{k}") for k in keys], *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(c) for n, c in zip(names, carried)])
    same = F.col("part") == F.col("_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = held.join(carries, same).withColumns({n: F.col(a) + F.col(b) for n, a, b in zip(names, local, carried)})
    return out.drop("part", "_part", *[f"_key_{k}" for k in keys], *local, *carried)
