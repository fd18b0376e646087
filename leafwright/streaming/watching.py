"""Progress of a running stream: each batch's ``done`` and ``total`` in a table, written by a listener."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from leafwright.functions.text import is_blank

PROGRESS = T.StructType([T.StructField(n, T.LongType()) for n in ("batch", "done", "total")])


def tracked(pairs: DataFrame, name: str = "progress") -> DataFrame:
    """A stream of pairs whose batches tell how many units they have and how many of these are translated."""
    return pairs.observe(name, F.count_if(~is_blank(F.col("translation"))).alias("done"), F.count(F.lit(1)).alias("total"))


class ProgressTable(StreamingQueryListener):
    """Writes ``batch, done, total`` of each batch of streams that observe ``name``, below ``folder``.

    Use it as a context around the stream: it is told of progress after the batch, so leaving the context waits until
    the stream's end has been told. A batch without rows tells nothing; one that runs again replaces its row.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str = "progress"):
        self.spark, self.folder, self.name = spark, folder, name
        self.ended = threading.Event()

    def __enter__(self):
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *failure):
        self.ended.wait(60)
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and row["total"]:
            number = event.progress.batchId
            self.spark.createDataFrame([(number, row["done"], row["total"])], PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/of={number}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def read(self) -> DataFrame:
        """``batch, done, total, done_so_far, total_so_far`` (a row for each batch)."""
        from pyspark.sql import Window as W

        rows = self.spark.read.schema(PROGRESS).parquet(self.folder).select(*PROGRESS.names)
        so_far = W.orderBy("batch")
        return rows.withColumns({"done_so_far": F.sum("done").over(so_far), "total_so_far": F.sum("total").over(so_far)})
