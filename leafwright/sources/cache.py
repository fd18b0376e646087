"""Fetching into a cache that keeps what it has: an injected function is asked once for each address."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.scratch import table
from leafwright.shelf import Shelf
from leafwright.shipping import ship


def kind(address: Column) -> Column:
    """The format an address has: ``epub`` if it says so anywhere, else ``txt``."""
    return F.when(address.contains("epub"), F.lit("epub")).otherwise(F.lit("txt"))


def fetched(candidates: DataFrame, folder: str, fetch: Callable[[str], bytes]) -> DataFrame:
    """``candidates`` with ``format``, ``path`` of the file in ``folder``, and ``error`` where there is none.

    Files are named by the SHA-256 of ``fetch_url``. Each address goes to one task, however many candidates share it; it
    is fetched only if its file isn't there, and the file is there whole from when it was fetched, so a task that
    runs again, or another job, finds it. A fetch that fails is reported and tried again by the next job. Candidates
    without an address have none. This runs a job.
    """
    ship(candidates.sparkSession)
    name = F.concat(F.sha2("fetch_url", 256), F.lit("."), kind(F.col("fetch_url")))
    addresses = candidates.select("fetch_url").where("fetch_url is not null and fetch_url <> ''").distinct().withColumn("name", name)
    schema = "fetch_url string, path string, error string"

    def run(frames):
        shelf = Shelf(folder)
        for frame in frames:
            errors = []
            for address, at in zip(frame["fetch_url"], frame["name"]):
                error = None
                try:
                    if not shelf.has(at):
                        shelf.put(at, fetch(address))
                except Exception as failure:  # reported in the error column
                    error = f"{type(failure).__name__}: {failure}"
                errors.append(error)
            yield frame.assign(path=[None if e else f"{folder.rstrip('/')}/{n}" for n, e in zip(frame["name"], errors)], error=errors)[["fetch_url", "path", "error"]]

    done = table(addresses.mapInPandas(run, schema), "fetched")
    rows = candidates.join(done, "fetch_url", "left").withColumn("format", kind(F.col("fetch_url")))
    return rows.withColumn("error", F.when(F.col("path").isNull(), F.coalesce("error", F.lit("no address"))))
