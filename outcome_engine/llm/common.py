"""Small helpers of the text operators: tables, stored intermediates, batches of texts."""

from __future__ import annotations

import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder

SLICE = 512  # texts that a task holds as Python objects at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a result that several jobs read to the shared folder, and read it from there.

    Cuts the lineage: a lost executor costs no more than the tasks that were running.
    """
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column="text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into short ones, so that few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def below(draw: Column, share: float) -> Column:
    """Whether a 64-bit hash is among the least `share` of its range."""
    return F.lit(True) if share >= 1 else draw <= int(-2 ** 63 + share * 2 ** 64)


def share_of(wanted: int, rows: int) -> float:
    """The share of the hashes that leaves about twice as many rows as are wanted."""
    return (2 * wanted + 64) / max(rows, 1)


def smallest_hashes(rows: DataFrame, draw: str, bound: int, total: int) -> list[Row]:
    """The `bound` rows of least hash, then of the other columns in their order; `total` says about how many there are.

    A threshold on the hash comes first, and is raised where it leaves too few, so what reaches the driver does not
    grow with the number of partitions, each of which would otherwise send as many rows as are wanted.
    """
    share = share_of(bound, total)
    while True:
        found = rows.where(below(F.col(draw), share)).orderBy(draw, *[c for c in rows.columns if c != draw]).limit(bound).collect()
        if len(found) == bound or share >= 1:
            return found
        share *= 4


def without_collection(function: Callable) -> Callable:
    """Holds back Python's cycle search while a function makes very many small objects without cycles; the search would
    take a fifth of its time."""

    @functools.wraps(function)
    def held(*args, **options):
        on = gc.isenabled()
        gc.disable()
        try:
            return function(*args, **options)
        finally:
            if on:
                gc.enable()

    return held
