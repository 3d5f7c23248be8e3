"""Line deduplication: hashes of lines in ranges, streamed in the order of documents, bitmaps of the lines that stay.

Every document gives one entry for each of its distinct lines. The entries are dealt into ranges by (line hash, document)
and sorted within them, so that a line that a third of all documents share takes as many ranges as it needs. A task
streams over its range and counts the documents of a line; it holds fewer than `least_documents` entries at a time. Only
the first and the last line of a range may go on in another one: their counts are added up in a table of two rows a range.
What comes out are the places of lines that go, and from these one compressed bitmap a document, never text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, strings, whole_text

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
ENTRY = "doc_id long, text_id binary, n_lines int, places array<int>, line binary"
DECIDED = f"{ENTRY}, documents long"


def text_id(text: str = "text") -> Column:
    """128 bits of the whole text: together with doc_id they name a document."""
    return F.unhex(F.md5(whole_text(text)))


def line_entries(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """One row a document and distinct line key: doc_id, text_id, n_lines, places (from 0), line (128-bit hash of the key).

    A key is the line without white space at its ends, A-Z lower-cased; keys of under `least_chars` code points have no entry.
    """

    def cut(batches):
        digest = xxhash.xxh3_128_digest
        for batch in slices(batches):
            ids, marks = batch.column(0), batch.column(1)
            rows, counts, places, lines = [], [], [], []
            for row, text in enumerate(strings(batch, "text")):
                cuts = text.split("\n")
                found: dict[bytes, list[int]] = {}
                for place, line in enumerate(cuts):
                    key = line.strip(SPACE)
                    if len(key) >= least_chars and key:
                        found.setdefault(digest(key.encode("utf-8", "surrogatepass").lower()), []).append(place)
                rows += [row] * len(found)
                counts += [len(cuts)] * len(found)
                lines += found.keys()
                places += found.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), marks.take(at), pa.array(counts, pa.int32()), pa.array(places, pa.list_(pa.int32())),
                 pa.array(lines, pa.binary())], names=["doc_id", "text_id", "n_lines", "places", "line"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("text_id"), whole_text().alias("text")
                       ).mapInArrow(cut, ENTRY)


def decide(entries: DataFrame, least_documents: int, keep_first: bool) -> DataFrame:
    """Streams over each range. Rows with places and no line are decided: these lines go. Rows with places and a line belong
    to the first or last line of a range and wait for the others; rows without places give its documents in this range, and
    the first of them."""
    names = ["doc_id", "text_id", "n_lines", "places", "line", "documents"]

    def stream(batches):
        current = previous = None
        held: list[tuple] = []  # entries of a line that is not in enough documents yet
        count, is_first, opening = 0, True, None

        def summary():
            return [(*opening, 0, None, current, count)] if current is not None else []

        for batch in batches:
            out: list[tuple] = []
            for doc, text, n_lines, places, line in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if line != current:
                    if is_first and current is not None:
                        out += summary()
                        is_first = False
                    current, previous, held, count, opening = line, None, [], 0, (doc, text)
                if (doc, text) == previous:  # a row that repeats is the same document
                    continue
                previous, count = (doc, text), count + 1
                if is_first:
                    out.append((doc, text, n_lines, places, line, None))
                    continue
                held.append((doc, text, n_lines, places, None, None))
                if count >= least_documents:
                    if keep_first and count == len(held):  # the line's first document keeps its first place
                        held[0] = (*held[0][:3], held[0][3][1:], None, None)
                    out += held
                    held = []
            if out:
                yield rows_to_batch(out)
        if current is not None:
            yield rows_to_batch([(*h[:4], current, None) for h in held] + summary())

    def rows_to_batch(rows):
        types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    order = ["line", "doc_id", "text_id"]
    ranged = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(stream, DECIDED)


def repeated_places(docs: DataFrame, least_documents: int, least_chars: int, keep_first: bool) -> DataFrame:
    """(doc_id, text_id, n_lines, places) of lines that go, possibly several rows a document."""
    entries = stored(line_entries(docs, least_chars), "line_entries")
    decided = stored(decide(entries, least_documents, keep_first), "line_decisions")
    settled = decided.where("line is null").select("doc_id", "text_id", "n_lines", "places")
    # two rows a range at most, however long the lists of documents are
    totals = decided.where("places is null").groupBy(F.col("line").alias("open_line")).agg(
        F.sum("documents").alias("total"), F.min(F.struct("doc_id", "text_id")).alias("opening")).where(F.col("total") >= least_documents)
    waiting = decided.where("line is not null and places is not null").join(F.broadcast(totals), F.col("line") == F.col("open_line"))
    if keep_first:
        leads = F.struct("doc_id", "text_id").eqNullSafe(F.col("opening"))
        waiting = waiting.withColumn("places", F.when(leads, F.expr("slice(places, 2, size(places))")).otherwise(F.col("places")))
    return settled.unionByName(waiting.select(*settled.columns)).where(F.size("places") > 0)


def keep_bitmaps(docs: DataFrame, least_documents: int = 10, least_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """One row for each document of `docs` (doc_id, text) that loses lines: doc_id, text_id, n_lines, n_dropped, keep.

    keep is a zlib-compressed bitmap: bit i (lowest first) says whether line i stays. A line whose key is found in at least
    `least_documents` documents goes from all of them; with `keep_first` its first place stays, in the order of doc_id (null
    first), text_id and position. Keys with under `least_chars` code points, and empty ones, always stay. Null texts are
    empty: one empty line. A document is named by doc_id and text: rows that repeat are one document, and rows with one
    doc_id, or none, but different texts are several. Other columns are ignored; an empty table gives an empty result.
    """

    def encode(batches):
        for batch in slices(batches):
            counts, bitmaps, dropped = batch.column(2).to_pylist(), [], []
            for n, places in zip(counts, batch.column(3).to_pylist()):
                stays = np.ones(n, np.uint8)
                stays[places] = 0
                dropped.append(n - int(stays.sum()))
                bitmaps.append(zlib.compress(np.packbits(stays, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(dropped, pa.int32()), pa.array(bitmaps, pa.binary())],
                names=["doc_id", "text_id", "n_lines", "n_dropped", "keep"])

    of_document = repeated_places(docs, least_documents, least_chars, keep_first).groupBy("doc_id", "text_id").agg(
        F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("places")).alias("places"))
    return of_document.mapInArrow(encode, "doc_id long, text_id binary, n_lines int, n_dropped int, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines long, n_dropped long) of every row of `docs`: the lines that its bitmap keeps, joined by line
    ends. The texts move once, whatever their number; they are not sorted."""

    def cut(batches):
        for batch in slices(batches):
            texts, counts, dropped = [], [], []
            for text, keep in zip(strings(batch, "text"), strings(batch, "keep")):
                lines = text.split("\n")
                counts.append(len(lines))
                if keep is not None:
                    stays = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines), bitorder="little")
                    lines = [line for line, stay in zip(lines, stays.tolist()) if stay]
                    text = "\n".join(lines)
                texts.append(text)
                dropped.append(counts[-1] - len(lines))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
                names=["doc_id", "text", "n_lines", "n_dropped"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    marks = bitmaps.select(F.col("doc_id").alias("of_doc"), F.col("text_id").alias("of_text"), "keep").hint("shuffle_hash")
    joined = named.join(marks, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (text_id() == F.col("of_text")), "left")
    return joined.select("doc_id", "text", "keep").mapInArrow(cut, "doc_id long, text string, n_lines long, n_dropped long")


def deduplicate_lines(docs: DataFrame, least_documents: int = 10, least_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Texts without repeated lines: keep_bitmaps and apply_bitmaps, whose rules hold."""
    bitmaps = stored(keep_bitmaps(docs, least_documents, least_chars, keep_first), "keep_bitmaps")
    return apply_bitmaps(docs, bitmaps)
