"""State that is kept as whole versions in a folder: written beside the last one, then published by one rename.

``data/<name>`` holds what was written, under a name of its own, and ``published/<number>`` is an empty marker of each
version whose name ends in the data's. A version exists from the rename of its marker on: a writer that dies before
leaves data nobody reads, and readers see the last version whole. Two writers can't publish one number, as a rename
doesn't replace what is there. The folder is on any file system that Hadoop reaches and that renames atomically.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class MissingVersion(LookupError):
    """A version that was asked for isn't there, or its data is gone."""


class Conflict(RuntimeError):
    """Somebody else has published this number."""


class Versions:
    """The versions of one table in ``folder``; ``schema`` is that of a state which has none yet."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Published versions in order."""
        return sorted(self._published())

    def _published(self) -> dict[int, str]:
        at = self._path(f"{self.folder}/published")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return {int(n): self._target(int(n)) for n in names if n.isdigit()}

    def _target(self, number: int) -> str:
        inside = self._fs.listStatus(self._path(f"{self.folder}/published/{number}"))
        return inside[0].getPath().getName()

    def write(self, rows: DataFrame) -> str:
        """Write data that isn't a version yet; returns its name."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{name}")
        return name

    def publish(self, number: int, name: str) -> None:
        """Make data version ``number``. Raises Conflict if that number is published; the data stays unused then."""
        draft = self._path(f"{self.folder}/drafts/{name}")
        self._fs.mkdirs(self._path(f"{self.folder}/published"))
        self._fs.mkdirs(self._path(f"{self.folder}/drafts/{name}/{name}"))
        final = self._path(f"{self.folder}/published/{number}")
        # A folder that is renamed onto one that exists would be moved into it, so that is looked for afterwards too.
        if self._fs.exists(final) or not self._fs.rename(draft, final) or self._target_count(final) != 1:
            self._fs.delete(self._path(f"{self.folder}/published/{number}/{name}"), True)
            self._fs.delete(draft, True)
            raise Conflict(f"version {number} of {self.folder} is published")

    def _target_count(self, final) -> int:
        return len(self._fs.listStatus(final))

    def save(self, rows: DataFrame, number: int | None = None) -> int:
        """Write and publish ``rows`` as the next version (or ``number``); returns its number."""
        name = self.write(rows)
        number = (self.numbers() or [-1])[-1] + 1 if number is None else number
        self.publish(number, name)
        return number

    def read(self, number: int | None = None) -> DataFrame:
        """A version, by default the last one; an empty table if there is none and none was asked for."""
        published = self._published()
        if number is None:
            if not published:
                return self.spark.createDataFrame([], self.schema)
            number = max(published)
        if number not in published:
            raise MissingVersion(f"version {number} of {self.folder} was never published, or has expired")
        at = f"{self.folder}/data/{published[number]}"
        if not self._fs.exists(self._path(f"{at}/_SUCCESS")):
            raise MissingVersion(f"version {number} of {self.folder} has lost its data")
        return self.spark.read.schema(self.schema).parquet(at)

    def expire(self, keep: int = 2) -> None:
        """Remove all versions but the last ``keep``, markers first, and then data of none (a dead writer's, not a running one's)."""
        published = self._published()
        for number in sorted(published)[: -keep or None]:
            self._fs.delete(self._path(f"{self.folder}/published/{number}"), True)
            self._fs.delete(self._path(f"{self.folder}/data/{published[number]}"), True)

    def sweep(self) -> None:
        """Remove data of no version. Only for when nobody is writing."""
        held = set(self._published().values())
        for kind in ("data", "drafts"):
            at = self._path(f"{self.folder}/{kind}")
            for status in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if status.getPath().getName() not in held:
                    self._fs.delete(status.getPath(), True)
