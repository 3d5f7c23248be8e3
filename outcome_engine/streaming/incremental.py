"""Incremental form: new files only, aggregated per micro-batch and merged on read."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from outcome_engine.functions.columns import ratio, total
from outcome_engine.operators.changes import ChangeRecords, merged_changes
from outcome_engine.operators.event_index import EventIndex
from outcome_engine.operators.labels import LABEL, label_outcomes
from outcome_engine.operators.merge import aggregate, compact
from outcome_engine.session import new_folder
from outcome_engine.sources.store import AggregateStore
from outcome_engine.spec import MetricSpec


def file_stream(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.parquet",
                file_type: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(file_type).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def load_new_files(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Copy records of files not seen before, exactly once: the checkpoint is the ledger."""
    return (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(target))


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives and dies with the checkpoint, so that a stream begun anew takes no other stream's batch numbers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/stream_name")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path, f"name={uuid.uuid4().hex}"))
    return sorted(s.getPath().getName() for s in fs.listStatus(path))[0].split("=")[1]


def merge_new_files(stream: DataFrame, specs: Mapping[str, MetricSpec], store: AggregateStore, checkpoint: str,
                    prepare: Callable[[DataFrame], DataFrame] | None = None,
                    changes: Mapping[str, ChangeRecords] | None = None, events: EventIndex | None = None) -> StreamingQuery:
    """Aggregate each micro-batch for every metric and store it under its stream and batch number, exactly once: a repeated
    batch overwrites itself, or is skipped where the table was compacted since.

    Without more, labels and touchpoints are resolved inside a batch. A metric with `changes` gets change records instead: a
    click in a later file takes the place of an earlier impression, and the sums are those of one load. With an event
    index, rows whose key an earlier batch had are dropped first. Both belong to this stream alone.
    """
    name_of_stream = stream_name(stream.sparkSession, checkpoint)
    changes = changes or {}

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        open_ = [n for n in specs if not store.has_merged(n, name_of_stream, batch_id)]
        if not open_:
            return
        rows = prepare(batch) if prepare else batch
        if events:
            rows = events.dedup(rows, batch_id)
        if len(open_) > 1 or events:  # several jobs read the batch: once from the source, then from the shared folder
            path = new_folder(batch.sparkSession, "batch")
            rows.write.parquet(path)
            rows = batch.sparkSession.read.schema(rows.schema).parquet(path)
        for name in open_:
            made = changes[name].changes(rows, batch_id) if name in changes else aggregate(rows, specs[name])
            store.write_batch(name, batch_id, made, name_of_stream)

    return (stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_merged(store: AggregateStore, name: str, spec: MetricSpec, changes: bool = False) -> DataFrame:
    """One row per dimension tuple; `changes`: the table holds change records."""
    return merged_changes(store.read(name), spec) if changes else compact(store.read(name), spec)


def dedup_stream(stream: DataFrame, time: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Drop repeats that arrive within `delay` of each other, also across files."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_ctr(stream: DataFrame, time: str, delay: str, positive: Sequence[str], negative: Sequence[str],
                 dims: Sequence[str] = (), width: str = "1 day") -> DataFrame:
    """Counts and CTR per tumbling window; rows later than the watermark are dropped. Store it with `write_windows`,
    which takes windows in while they are open."""
    labelled = label_outcomes(stream, positive, negative).withWatermark(time, delay)
    counted = labelled.groupBy(F.window(time, width), *dims).agg(
        F.count("*").alias("Count"), total(LABEL).alias("Positives"))
    return counted.select(F.col("window.start").alias("window_start"), *dims, "Count", "Positives",
                          (F.col("Count") - F.col("Positives")).alias("Negatives"),
                          ratio("Positives", "Count").alias("CTR"))


def write_windows(counted: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write every window that a micro-batch changed, below its batch id; a repeated batch overwrites itself."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (counted.writeStream.outputMode("update").foreachBatch(one_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_windows(spark: SparkSession, target: str, dims: Sequence[str] = ()) -> DataFrame:
    """The latest state of every window, open ones included."""
    changes = spark.read.parquet(target)
    keys = ["window_start", *dims]
    values = [c for c in changes.columns if c not in (*keys, "batch")]
    latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__now"))
    return latest.select(*keys, "__now.*")
