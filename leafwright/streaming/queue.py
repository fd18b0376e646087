"""The push queue as a stream of log events: each micro-batch updates the queue and drains it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.operators import state
from leafwright.operators.scan import running
from leafwright.scratch import table
from leafwright.versions import Versions

LOG = T.StructType([T.StructField("path", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("title", T.StringType())])


ITEMS = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("title", T.StringType()), ("queued_seq", T.LongType()), ("attempts", T.LongType()), ("last_attempt_seq", T.LongType()))])


def run(spark: SparkSession, events: str, store: str, checkpoint: str, outcomes: Callable[[DataFrame, int], DataFrame | None], every: str | None = None, files: int | None = None, keep: int = 3):
    """Start a query over Parquet events in ``events`` (``LOG``); returns the StreamingQuery.

    Each batch advances the queue that the batch before left by its own events, and drains it: ``outcomes(queue,
    number)`` says for ``path`` whether it ``exists``, was ``pushed`` or ``skipped`` (and may give ``ip, source``), or is
    None if no device was found, which leaves the queue as it is. ``store`` has the summary of each pass and the queue
    after each batch as a version of that number, the last ``keep`` of them. A batch's version is published last, by one
    rename: a batch that is run again after that does nothing, one that died before starts over from the version before
    it, and if that is missing the query fails. A store that has versions belongs to its checkpoint. The order of things
    is batch by batch, and events before the pass, so ``last_attempt_seq`` of the pass is the last event's number so far.
    Without ``every`` (a processing time) the query takes what there is and ends; ``files`` bounds the files of a batch.
    """
    versions = _versions(spark, store)
    if versions.numbers() and not _exists(spark, f"{checkpoint}/metadata"):
        raise ValueError(f"{store} has the queue of another checkpoint than {checkpoint}")

    def batch(rows: DataFrame, number: int) -> None:
        if number in versions.numbers():
            return
        held = table(state.advanced(versions.read(number - 1 if number else None), rows), "queue")
        last = max(held.agg(F.max(F.greatest("queued_seq", F.coalesce("last_attempt_seq", "queued_seq")))).first()[0] or 0, rows.agg(F.max("seq")).first()[0] or 0)
        found = outcomes(held, number)
        tick = F.lit(number).cast("long").alias("tick")
        items = running(held.select(tick, "path", "queued_seq"), ["tick"], ["queued_seq", "path"], {"pos": F.lit(1)})
        if found is None:
            results = items.withColumn("result", F.lit("waiting"))
            left, devices = held, spark.createDataFrame([], "tick long, ip string, source string")
        else:
            found = table(found, "outcomes")
            results = table(state.drained(items, found.select(tick, "path", "exists", "pushed", "skipped")), "results")
            tried = F.col("result").isin("pushed", "failed")
            left = held.join(results.select("path", "result"), "path").where("result in ('failed', 'waiting')")
            left = left.withColumn("attempts", F.col("attempts") + tried.cast("long")).withColumn("last_attempt_seq", F.when(tried, F.lit(last)).otherwise(F.col("last_attempt_seq"))).select(ITEMS.names)
            address = [F.first(c).alias(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in ("ip", "source")]
            devices = found.agg(F.count(F.lit(1)).alias("n"), *[a for c, a in zip(("ip", "source"), address) if c in found.columns])
            devices = devices.select(tick, *[F.coalesce(c, F.lit("unknown")).alias(c) if c in found.columns else F.lit("unknown").alias(c) for c in ("ip", "source")])
        state.drain_summary(results, devices).write.mode("overwrite").parquet(f"{store}/summary/batch={number}")
        versions.save(left, number)
        versions.expire(keep)

    reader = spark.readStream.schema(LOG)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    writer = reader.parquet(events).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _versions(spark: SparkSession, store: str) -> Versions:
    return Versions(spark, f"{store}/queue", ITEMS)


def stored_queue(spark: SparkSession, store: str) -> DataFrame:
    """The queue after the last batch."""
    return _versions(spark, store).read()


def summaries(spark: SparkSession, store: str) -> DataFrame:
    """The summary of each pass that had something queued."""
    return spark.read.parquet(f"{store}/summary").drop("batch")
