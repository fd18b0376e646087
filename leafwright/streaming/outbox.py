"""Messages that are told once: kept before an injected sender sees them, and marked before each call."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.shelf import Shelf
from leafwright.shipping import ship

MESSAGES = T.StructType([T.StructField("id", T.StringType()), T.StructField("message", T.StringType())])
_ACKS = T.StructType([T.StructField("id", T.StringType()), T.StructField("result", T.StringType()), T.StructField("error", T.StringType())])


class Outbox:
    """Messages ``id, message`` in ``folder`` and what became of each.

    ``post`` keeps the messages of a batch under its number, without those an earlier batch had (a batch that runs
    again replaces its own), and then delivers what was kept and never tried. A task marks a message before it calls
    ``send(message)``, so a message is tried once: one that was marked by a run that died is not sent again but
    reported as *in doubt*, as nobody can say whether it went out. ``send`` may raise; that is *failed*.
    """

    def __init__(self, spark: SparkSession, folder: str, send: Callable[[str], None]):
        self.spark, self.folder, self.send = spark, folder.rstrip("/"), send
        ship(spark)

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def post(self, messages: DataFrame, number: int) -> None:
        """Keep the messages of batch ``number`` and deliver. Of messages of one id in a batch the least is kept; null ids are dropped."""
        held = self._read("posted", T.StructType([*MESSAGES.fields, T.StructField("batch", T.LongType())]))
        fresh = messages.where("id is not null").groupBy("id").agg(F.min("message").alias("message"))
        fresh = fresh.join(held.where(F.col("batch") != number).select("id"), "id", "left_anti")
        fresh.select(MESSAGES.names).write.mode("overwrite").parquet(f"{self.folder}/posted/batch={number}")
        self.deliver()

    def deliver(self) -> None:
        """Send what was kept and has no result yet."""
        send, folder = self.send, self.folder

        def run(frames):
            marks = Shelf(f"{folder}/marks")
            for frame in frames:
                results, errors = [], []
                for mark, message in zip(frame["mark"], frame["message"]):
                    result, error = "in doubt", None
                    if not marks.has(mark):
                        marks.put(mark, b"")
                        try:
                            send(message)
                            result = "sent"
                        except Exception as failure:  # reported with the message
                            result, error = "failed", f"{type(failure).__name__}: {failure}"
                    results.append(result)
                    errors.append(error)
                yield frame[["id"]].assign(result=results, error=errors)

        waiting = self._read("posted", MESSAGES).join(self._read("results", _ACKS).select("id"), "id", "left_anti")
        rows = waiting.select("id", "message", F.sha2("id", 256).alias("mark")).mapInPandas(run, _ACKS)
        rows.write.parquet(f"{self.folder}/results/of={uuid.uuid4().hex}")

    def status(self) -> DataFrame:
        """``id, message, result, error``; the result of a message that wasn't tried yet is *waiting*."""
        rows = self._read("posted", MESSAGES).select(MESSAGES.names).join(self._read("results", _ACKS).select(_ACKS.names), "id", "left")
        return rows.withColumn("result", F.coalesce("result", F.lit("waiting")))
