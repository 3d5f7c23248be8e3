"""Exact deduplication with a persistent digest index: DataFrame and SQL operations only.

The index is a Parquet table bucketed and sorted by digest: one row for each text seen so far, with the document that
stands for it and how many rows had it. New data is reduced to one row a digest, those already known are removed by a
sort-merge anti-join, for which the index needs no shuffle, and the rest is appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, whole_text

HEAVY_SHARE = 1000  # a digest with over one row in so many is heavy; there can't be more than that many of them


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the whole text in UTF-8, lower-case hex; null counts as empty."""
    return F.sha2(whole_text(text), 256)


class DigestIndex:
    """A digest index below `path`, under the table name `name`; it is created if nothing is there.

    `buckets` is fixed when the index is created: choose it for the size it will grow to.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name = spark, name
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT, group_size BIGINT)
                      USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'""")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of `groups` (one a digest) whose digest the index lacks."""
        return groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add groups (digest, keep_id, group_size) that are not there yet. Run again after a failure, it adds only the
        rest, since what is there already is removed first."""
        self.unseen(groups).select("digest", "keep_id", "group_size").write.insertInto(self.name)


def digest_groups(digests: DataFrame) -> DataFrame:
    """One row a digest: the largest doc_id and the number of rows, combined before the shuffle."""
    return digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def with_groups(digests: DataFrame, groups: DataFrame) -> DataFrame:
    """Join every row with its group. Heavy digests, of which there are HEAVY_SHARE at most whatever the input, are
    joined by broadcast, so that no task gets all rows of one; the others by a shuffle."""
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    is_heavy = F.col("group_size") * HEAVY_SHARE > total
    heavy = groups.where(is_heavy).select("digest", F.col("keep_id").alias("heavy_id"), F.col("group_size").alias("heavy_size"), F.col("fresh").alias("heavy_fresh"))
    marked = digests.join(F.broadcast(heavy), "digest", "left")
    common = marked.where("heavy_size is not null").select(
        *digests.columns, F.col("heavy_id").alias("keep_id"), F.col("heavy_size").alias("group_size"), F.col("heavy_fresh").alias("fresh"))
    rare = marked.where("heavy_size is null").select(*digests.columns).join(groups.where(~is_heavy), "digest")
    return common.unionByName(rare.select(*common.columns))


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Take `docs` (doc_id, text) into the index; returns doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Of equal texts the largest doc_id stays, unless the index knew the text before: then the document that stands for it
    there stays (keep_id) and all new rows go. group_size counts the rows of `docs` with that text. Null texts are
    empty ones. A null doc_id loses to any other; a group of only such rows keeps them all. Rows that repeat with the
    doc_id that stays are the same document and stay. Other columns are ignored; an empty table gives an empty result.
    """
    digests = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest")), "digests")
    own = stored(digest_groups(digests), "groups")
    fresh = index.unseen(own).withColumn("fresh", F.lit(True))
    known = own.join(index.rows().select("digest", F.col("keep_id").alias("known_id")).hint("merge"), "digest")
    groups = stored(
        fresh.select("digest", "keep_id", "group_size", "fresh").unionByName(
            known.select("digest", F.col("known_id").alias("keep_id"), "group_size", F.lit(False).alias("fresh"))), "resolved")
    index.append(own)
    return with_groups(digests, groups).select(
        "doc_id", "keep_id", "group_size", (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"))


def keep_distinct(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of `docs` that deduplicate() keeps, with all their columns. Rows that go are named by (doc_id, digest) and
    removed by an anti-join, which leaves every row of a document that stays. Null texts are empty ones, and rows without
    doc_id go where a row with the same text has one. The texts are shuffled once, unsorted, at every size; columns may
    have any names."""
    gone = deduplicate(docs, index).where(~F.col("kept")).select("doc_id", "text_sha256").distinct()
    gone = stored(gone, "gone").hint("shuffle_hash")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"]) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == gone["text_sha256"]), "left_anti")
