"""Token-id files: length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A record is   length u64 | masked checksum of the length u32 | payload | masked checksum of the payload u32,
all little-endian; the payload is doc_id i64 (the smallest i64 for null) followed by the ids, u16 or u32. The checksum
is CRC-32 as in zlib, masked: rotated right by 15 bits plus 0xa282ead8. Beside `part-00007.<attempt>.rec` lies
`part-00007.<attempt>.idx` with each record's offset, u64. The manifest, a small Parquet table written when all files
are complete, names the files that count: what a lost or repeated task left behind is not in it.

Files are written by the tasks through pyarrow's file systems, so the folder may be any URI they know (file, hdfs, s3, gs).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_folder
from .common import slices, strings, whole_text
from .tokens import CachedEncoder

NULL_ID = -(1 << 63)
MASK = 0xA282EAD8
BUFFER = 1 << 20
MANIFEST = "part int, path string, records long, tokens long, bytes long, width int"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def read_frame(stream, path: str) -> bytes | None:
    """Next payload, None at the end; a damaged or cut record raises."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError(f"damaged length in {path}")
    size = struct.unpack("<Q", head[:8])[0]
    body = stream.read(size + 4)
    if len(body) < size + 4 or masked(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise ValueError(f"damaged record in {path}")
    return body[:-4]


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """ids: little-endian u32."""
    numbers = np.frombuffer(ids, "<u4")
    return struct.pack("<q", NULL_ID if doc_id is None else doc_id) + (numbers.astype("<u2").tobytes() if width == 2 else ids)


def open_payload(payload: bytes, width: int) -> tuple[int | None, bytes]:
    doc_id = struct.unpack("<q", payload[:8])[0]
    ids = payload[8:]
    return None if doc_id == NULL_ID else doc_id, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids


# ------------------------------------------------------------------ writing

def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Encodes every whole text, appends `end_id`, and writes the records in ascending doc_id order; returns the manifest.

    Null texts count as empty; null doc_ids come first; rows that repeat are written as often as they occur. The text
    crosses one range shuffle; its files are as many as that has partitions, ordered by `part`.
    """
    spark = docs.sparkSession
    end = struct.pack("<I", end_id)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text").withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]):
        encoder = CachedEncoder(tokenizer)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        system, base = file_system(folder)
        part = out = stem = None
        offsets: list[int] = []
        at = tokens = 0
        try:
            for batch in slices(batches):
                if out is None:
                    part = batch.column(2)[0].as_py()
                    stem = f"{base}/part-{part:05d}.{uuid.uuid4().hex}"
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(stem + ".rec", buffer_size=BUFFER)
                for doc_id, ids in zip(strings(batch, "doc_id"), encoder.encode(strings(batch, "text"))):
                    record = frame(payload_of(doc_id, ids + end, width))
                    out.write(record)
                    offsets.append(at)
                    at += len(record)
                    tokens += len(ids) // 4 + 1
        finally:
            if out is not None:
                out.close()
        if out is not None:
            with system.open_output_stream(stem + ".idx") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            yield pa.RecordBatch.from_pylist(
                [dict(part=part, path=stem.rsplit("/", 1)[1], records=len(offsets), tokens=tokens, bytes=at, width=width)],
                schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()),
                                  ("bytes", pa.int64()), ("width", pa.int32())]))

    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


# ------------------------------------------------------------------ reading

def with_starts(files: DataFrame) -> DataFrame:
    """Adds `start`: the tokens in all files before. One row a file, so a window over all of them stays small; blocks of
    1024 files keep even that apart."""
    block = F.floor(F.col("part") / 1024)
    inner = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocked = files.withColumn("block", block)
    totals = blocked.groupBy("block").agg(F.sum("tokens").alias("t")).select(
        "block", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("before"))
    return blocked.join(totals, "block").withColumn(
        "start", F.col("before") + F.coalesce(F.sum("tokens").over(inner), F.lit(0))).drop("block", "before")


def read_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, record) of every record; start counts the ids of all records before.
    A file is read by one task as a stream, each record checked."""
    files = with_starts(manifest(spark, folder))

    def read(batches):
        system, base = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start, number, rows = row["start"], 0, []
                with system.open_input_stream(f"{base}/{row['path']}.rec", buffer_size=BUFFER) as stream:
                    while (payload := read_frame(stream, row["path"])) is not None:
                        doc_id, ids = open_payload(payload, row["width"])
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), row["part"], number))
                        start, number = start + len(ids) // 4, number + 1
                        if len(rows) == 4096:
                            yield digest_rows(rows)
                            rows = []
                if number != row["records"]:
                    raise ValueError(f"{row['path']}: {number} records, the manifest has {row['records']}")
                yield digest_rows(rows)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, as the few manifest rows would else meet in one task
    return files.repartitionByRange(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, record long")


def digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 4 + (pa.int32(), pa.int64()))],
        names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "record"])


def read_shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """(draw, doc_id, ids array<int>) of every record in a random order fixed by `seed`, read by the offset index.

    Records are dealt to tasks by their draw; a task opens each file it needs once and seeks. Sort by draw to consume."""
    files = manifest(spark, folder).where("records > 0")
    chosen = files.select("path", "part", "width", F.explode(F.sequence(F.lit(0), F.col("records") - 1)).alias("record")).withColumn(
        "draw", F.xxhash64(F.lit(seed), "part", "record"))

    def read(batches):
        system, base = file_system(folder)
        path = stream = offsets = None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    path = row["path"]
                    with system.open_input_stream(f"{base}/{path}.idx") as index:
                        offsets = np.frombuffer(index.read(), "<u8")
                    stream = system.open_input_file(f"{base}/{path}.rec")
                stream.seek(int(offsets[row["record"]]))
                doc_id, ids = open_payload(read_frame(stream, path), row["width"])
                rows.append(dict(draw=row["draw"], doc_id=doc_id, ids=np.frombuffer(ids, "<u4").tolist()))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("draw", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return chosen.repartitionByRange(n, "draw").sortWithinPartitions("path", "record").mapInArrow(
        read, "draw long, doc_id long, ids array<int>")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the files of `docs` to the shared folder, reads them back, and returns doc_id, start, n_tokens, ids_crc32.
    An empty table gives no file and no rows."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token_files")
    write_token_files(docs, folder, tokenizer, end_id)
    return read_in_order(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
