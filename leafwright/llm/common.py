"""Plumbing shared by the corpus operators: shipping code, shared scratch tables, hold-out rule.

Executors may be lost at any time, so intermediate results that are used more than once are written
as Parquet tables below ``spark.checkpoint.dir`` (a folder all machines share) and read again; nothing
is kept in a machine-local folder and nothing is locally checkpointed.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.scratch import scratch, table  # noqa: F401
from leafwright.shipping import ship  # noqa: F401


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished steps, which it does once their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(columns: list[str], name: str) -> str:
    """``name``, or something longer that neither names nor begins the name of a column."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text is a multiple of 5; rows without an id count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizer files keep ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with a callable object that turns a record batch into a dict of columns."""
    ship(df.sparkSession)
    names = [f.name for f in schema.fields]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                yield pa.RecordBatch.from_arrays([_as_array(out[n], arrow.field(n).type) for n in names], names=names)
                del out, batch
                trim()

    run.owner = getattr(function, "owner", type(function).__module__)
    return df.mapInArrow(by_partition(run), schema)


def by_group(function):
    """A plain function for ``applyInArrow``, which looks at a function's own signature."""
    owner = type(function).__module__

    def run(group):
        process_state(owner)
        return function(group)

    return run


def by_partition(function):
    """``function`` over a partition's batches for ``mapInArrow``; the worker gives memory back before and after."""
    owner = getattr(function, "owner", type(function).__module__)

    def run(batches):
        process_state(owner)
        yield from function(batches)
        trim()

    return run


def _as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype != object:
        return pa.array(values).cast(kind)
    return pa.array(values, type=kind)


def process_state(owner: str) -> dict:
    """A dict that several tasks of a Python worker can use for caches.

    The owner is the module that keeps it; a function of another module that uses it names it as its ``owner``.
    Workers outlive the operators that use them, so there is one dict at a time: another owner empties it.
    """
    import builtins

    held = getattr(builtins, "_leafwright_state", None)
    if held is None or held[0] != owner:
        builtins._leafwright_state = held = None  # freed before the next one grows
        gc.collect()
        trim()
        builtins._leafwright_state = held = (owner, {})
    return held[1]


def trim() -> None:
    """Give free memory of this Python worker back.

    Workers share an executor's memory with its JVM and outlive the stage; the allocator keeps what a batch with long
    texts took, and two workers of one executor would hold that at once. One call takes far less time than a batch.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Recent(dict):
    """A cache of bounded size: two generations, of which the older one goes when the younger one is full."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most // 2, {}

    def find(self, key):
        """The value, or None; what is found in the older generation moves to the younger one."""
        value = self.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
