"""Tables that are replaced as a whole, in versions: readers keep the version they began with.

    <table>/data/<id>/            the files of a version, written before anybody can see them
    <table>/versions/<n>-<id>     an empty file: version n is the data of that id

A version exists once its empty file does, which file systems create in one step. A write that
is killed leaves data that no version names; readers go on with the last version. The largest
name is the current version, so writers that meet at one number still leave one winner.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

# Versions that stay when a new one is published: the readers of those before it go on.
KEEP = 2


@dataclass(frozen=True)
class Version:
    number: int
    data: str

    @property
    def name(self) -> str:
        return f"{self.number:012d}-{self.data}"


@dataclass(frozen=True)
class SnapshotTable:
    """One versioned table at `path`, on any file system that Spark reaches."""

    spark: SparkSession
    path: str
    fmt: str = "parquet"

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[Version]:
        """Published versions, oldest first."""
        files, folder = self._at("versions")
        if not files.exists(folder):
            return []
        names = sorted(status.getPath().getName() for status in files.listStatus(folder))
        return [Version(int(number), data) for number, _, data in (n.partition("-") for n in names) if number.isdigit()]

    def publish(self, df: DataFrame, keep: int = KEEP) -> Version:
        """Write `df` beside the table, make it the current version, and remove all but the last `keep`."""
        data = uuid.uuid4().hex
        writer = df.write.mode("error")
        if self.fmt == "csv":
            writer = writer.option("header", True)
        writer.format(self.fmt).save(f"{self.path.rstrip('/')}/data/{data}")
        before = self.versions()
        version = Version(before[-1].number + 1 if before else 1, data)
        files, marker = self._at("versions", version.name)
        files.create(marker, False).close()
        for old in self.versions()[:-keep]:
            self._remove(old)
        return version

    def _remove(self, version: Version) -> None:
        files, marker = self._at("versions", version.name)
        files.delete(marker, False)
        files, data = self._at("data", version.data)
        files.delete(data, True)

    def read(self, schema: str | None = None, number: int | None = None) -> DataFrame:
        """The current version, or that of a number that is still kept; `schema` is needed for CSV."""
        found = [v for v in self.versions() if number in (None, v.number)]
        if not found:
            raise FileNotFoundError(f"no version {number or ''} of {self.path}".replace("  ", " "))
        reader = self.spark.read.format(self.fmt)
        if self.fmt == "csv":
            reader = reader.option("header", True).option("enforceSchema", False)
        if schema is not None:
            reader = reader.schema(T.StructType.fromDDL(schema))
        return reader.load(f"{self.path.rstrip('/')}/data/{found[-1].data}")

    def remove_unpublished(self) -> int:
        """Remove data that no version names, left by killed writes; not while others write."""
        files, folder = self._at("data")
        if not files.exists(folder):
            return 0
        known = {v.data for v in self.versions()}
        left = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName() not in known]
        for path in left:
            files.delete(path, True)
        return len(left)
