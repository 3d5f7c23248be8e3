"""Aggregate tables on the shared file system: Parquet folders, replaced by whole versions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STREAM_BATCH = re.compile(r"/batch=([^/]+)\.(\d{12})$")
NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


class AggregateStore:
    """`root/<table>/version=<n>/batch=<id>`. Appends add a batch; a replacement is written as the next version, so a lost
    job leaves the old version readable. A folder counts once it has `_SUCCESS`.

    Batches of a stream are named by stream and number. A version keeps, in `merged`, up to which number it holds each
    stream's batches: one that comes again after it was merged is skipped, so every batch counts exactly once.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _children(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _folder(self, name: str) -> str:
        if not NAME.match(name):
            raise ValueError(f"not a table name: {name!r}")
        return f"{self.root}/{name}"

    def _versions(self, name: str) -> list[int]:
        folder = self._folder(name)
        numbers = sorted(int(c.split("=")[1]) for c in self._children(folder) if c.startswith("version="))
        return [n for n in numbers if (self._parts(f"{folder}/version={n}") if n == 0
                                       else self._exists(f"{folder}/version={n}/batch=base/_SUCCESS"))]

    def _parts(self, version: str) -> list[str]:
        """Complete batches; what a lost job left half-written is not read."""
        found = [f"{version}/{c}" for c in self._children(version) if c.startswith("batch=")]
        return sorted(p for p in found if self._exists(f"{p}/_SUCCESS"))

    def _current(self, name: str) -> str:
        versions = self._versions(name)
        return f"{self._folder(name)}/version={versions[-1] if versions else 0}"

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def names(self) -> list[str]:
        return sorted(c for c in self._children(self.root) if NAME.match(c) and self.exists(c))

    def append(self, name: str, df: DataFrame) -> None:
        """Create the table or add rows to it."""
        self.write_batch(name, uuid.uuid4().hex if self.exists(name) else "base", df)

    def write_batch(self, name: str, batch_id: int | str, df: DataFrame, stream: str | None = None) -> None:
        """Idempotent: the same batch written again replaces itself, or is skipped where a version has taken it in."""
        if stream is None:
            df.write.mode("overwrite").parquet(f"{self._current(name)}/batch={batch_id}")
        elif not self.has_merged(name, stream, int(batch_id)):
            df.write.mode("overwrite").parquet(f"{self._current(name)}/batch={stream}.{int(batch_id):012d}")

    def has_merged(self, name: str, stream: str, batch_id: int) -> bool:
        return self._merged(self._current(name)).get(stream, -1) >= batch_id

    def _merged(self, version: str) -> dict[str, int]:
        """Streams and the last of their batches that this version was made from."""
        if not self._exists(f"{version}/merged/_SUCCESS"):
            return {}
        return {r.stream: r.batch for r in self.spark.read.schema("stream string, batch long").json(f"{version}/merged").collect()}

    def read(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise ValueError(f"no table {name!r}")
        return self.spark.read.option("mergeSchema", "true").parquet(*self._parts(self._current(name)))

    def replace(self, name: str, df: DataFrame) -> None:
        """Write the next version, made from the current one (which `df` may read) and the batches there are now. The version
        before stays for those who still read it; older ones go. Not while a stream writes batches."""
        versions = self._versions(name)
        if not versions:
            self.write_batch(name, "base", df)
            return
        folder, current = self._folder(name), self._current(name)
        merged = self._merged(current)
        for part in self._parts(current):
            if found := STREAM_BATCH.search(part):
                merged[found[1]] = max(merged.get(found[1], -1), int(found[2]))
        following = f"{folder}/version={versions[-1] + 1}"
        rows = self.spark.createDataFrame(list(merged.items()), "stream string, batch long")
        rows.coalesce(1).write.mode("overwrite").json(f"{following}/merged")
        df.write.mode("overwrite").parquet(f"{following}/batch=base")
        for n in versions[:-1]:
            self._delete(f"{folder}/version={n}")

    def drop(self, name: str) -> None:
        self._delete(self._folder(name))

    def drop_all(self) -> None:
        for name in self.names():
            self.drop(name)


# ---- export and import ------------------------------------------------------------------------------


def export_json(frames: Mapping[str, DataFrame], folder: str) -> None:
    """One JSON folder per table; sketches as base64 text."""
    for name, df in frames.items():
        encoded = {f.name: F.base64(f.name) for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)}
        (df.withColumns(encoded) if encoded else df).write.mode("overwrite").json(f"{folder}/{name}")


def import_json(spark: SparkSession, folder: str, schemas: Mapping[str, T.StructType]) -> dict[str, DataFrame]:
    out = {}
    for name, schema in schemas.items():
        binary = [f.name for f in schema.fields if isinstance(f.dataType, T.BinaryType)]
        text = T.StructType([T.StructField(f.name, T.StringType() if f.name in binary else f.dataType)
                             for f in schema.fields])
        df = spark.read.schema(text).json(f"{folder}/{name}")
        out[name] = df.withColumns({b: F.unbase64(b) for b in binary}) if binary else df
    return out


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)
