"""Data sources: pages of a catalogue that follow one another, and files that are written as one set.

    register(spark, page_source(fetch, first))
    pages = spark.read.format("catalogue_pages").option("limit", 8).load().where("query = 'austen'")
    payloads.catalogue(pages)

Filters on ``query`` reach the source and are all it asks for; without one the option ``queries``, a JSON list, says
what to ask.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from leafwright.shelf import Shelf
from leafwright.shipping import ship


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Make a source known to the session, in which Python sources are given filters from then on."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


class _Pages(DataSourceReader):
    def __init__(self, options, fetch, first):
        self.fetch, self.first, self.limit = fetch, first, int(options.get("limit", 8))
        listed = options.get("queries")
        self.queries = None if listed is None else list(dict.fromkeys(json.loads(listed)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("query",):
                wanted = [f.value]
            elif isinstance(f, In) and f.attribute == ("query",):
                wanted = list(f.value)
            elif isinstance(f, IsNotNull) and f.attribute == ("query",):
                continue  # queries that are asked are never null
            else:
                yield f
                continue
            self.queries = list(dict.fromkeys(q for q in wanted if q is not None and (self.queries is None or q in self.queries)))

    def partitions(self) -> list[InputPartition]:
        if self.queries is None:
            raise ValueError("no query: filter on it, or name them in the option queries")
        return [InputPartition(q) for q in self.queries] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """The pages of a query until they have as many results as asked for; the address of the next one is in each."""
        address, page, have = None if partition.value is None else self.first(partition.value), 0, 0
        while address and have < self.limit:
            body = self.fetch(address)
            found = json.loads(body)
            yield partition.value, page, body
            page, have, address = page + 1, have + len(found.get("results") or []), found.get("next")


def page_source(fetch: Callable[[str], str], first: Callable[[str], str], name: str = "catalogue_pages") -> type[DataSource]:
    """A source of ``query, page_no, body``, to be registered: one task a query, which follows the pages of its answer.

    ``fetch(address)`` gives a page's JSON text and ``first(query)`` the address of the first page; both run in tasks. A
    task that runs again fetches again. A fetch or JSON that fails, fails the read.
    """

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "query string, page_no long, body string"

        def reader(self, schema):
            return _Pages(self.options, fetch, first)

    return Pages


@dataclass
class _Written(WriterCommitMessage):
    files: list  # of (name, draft)


class _Files(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows) -> _Written:
        shelf, files = Shelf(self.path), []
        for row in rows:
            if row["name"] is None or row["content"] is None or "/" in row["name"] or row["name"].startswith(("_", ".")):
                raise ValueError(f"{row['name']!r} is no file name, or has no content")
            files.append((row["name"], shelf.draft(bytes(row["content"]))))
        return _Written(files)

    def commit(self, messages) -> None:
        """Names go up all at once or, if any is there twice, none."""
        shelf = Shelf(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        there = set(shelf.names())
        seen = set() if self.overwrite else set(there)
        for name, _ in files:
            if name in seen:
                raise FileExistsError(f"{name} is there already")
            seen.add(name)
        for name, draft in files:
            shelf.keep(draft, name)
        if self.overwrite:
            for name in there - seen:
                shelf.remove(name)

    def abort(self, messages) -> None:
        shelf = Shelf(self.path)
        for m in messages:
            for _, draft in m.files if m is not None else []:
                shelf.drop(draft)


class FileSink(DataSource):
    """``rows.write.format("named_files").mode("append").option("path", folder).save()`` of ``name string, content binary``.

    Tasks write drafts, which readers don't see; when all tasks are done the drafts get their names. Of a task that
    fails and runs again, or runs twice, only the attempt that Spark counts is published. A name that is there
    already, or comes twice, fails the whole write; with ``overwrite`` the folder holds the new files only. Names go
    through the driver, contents don't.
    """

    @classmethod
    def name(cls):
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool):
        return _Files(self.options, overwrite)
