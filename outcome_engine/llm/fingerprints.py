"""I-Match document fingerprints: DataFrame and SQL operations only.

The lexicon is the band of all terms that at most a third of the documents have; it has no lower end, so that rare
languages, sources and single documents keep their own terms. A fingerprint holds a hash of all the document's distinct
terms in the lexicon, and one for each of many random parts of the lexicon. Each part has finer and finer subsets, without
end; the hash is that of the finest subset with a term of the document, which holds a single one of its terms, however long
the document. So the share of equal hashes is close to the share of common terms. Only the terms beyond the band are ever
gathered: each is in over a third of the documents, so there are at most three times as many as a document has
distinct terms on average, however many documents there are.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, digits

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_text

LEAST_IDF = math.log(3)  # of the terms in the lexicon: at most a third of the documents have them
PART_BITS = 7  # there are 2^7 = 128 disjoint parts of the lexicon
DIGITS = 6  # hexadecimal digits of each part's hash, behind two of its number
WHOLE = 16  # hexadecimal digits of the hash of all terms, in front of the parts
RANGES_PER_PARTITION = 4  # ranges of doc_id for each shuffle partition


#: fixed: every character but letters, marks and digits; ASCII ones stand apart, as the regular expression engine looks them up in a table
BREAKS = f"[^{ascii_lowercase}{digits}\\p{{L}}\\p{{M}}\\p{{N}}]+"


def terms(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits of any script; repeats included, empty where a text begins or ends with a sign."""
    return F.split(F.lower(text), BREAKS)


def codes(text: Column) -> Column:
    """Hashes of a text's distinct terms."""
    return F.array_distinct(F.transform(F.filter(terms(text), lambda t: t != ""), lambda t: F.xxhash64(t)))


def counts(docs: DataFrame, least_idf: float = LEAST_IDF) -> DataFrame:
    """(code, df, known): documents that have a term, and whether it is in the lexicon. Counts cover all documents."""
    high = max(2.0, docs.count() * math.exp(-least_idf))
    return docs.select(F.explode(codes(whole_text())).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df")).withColumn(
        "known", F.col("df") <= high)


def lexicon(docs: DataFrame, least_idf: float = LEAST_IDF) -> DataFrame:
    """(code): hashes of the terms in the band."""
    return counts(docs, least_idf).where("known").select("code")


def common_codes(docs: DataFrame, least_idf: float = LEAST_IDF) -> Column:
    """Hashes of the terms beyond the band, an array of the bounded size above."""
    found = counts(docs, least_idf).where("not known").select("code").collect()
    return F.lit([r["code"] for r in found]) if found else F.array().cast("array<bigint>")


def hexadecimal(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def part_of(code: Column) -> Column:
    """The highest bits of a term's hash; those below, in their order, tell the finest subset that holds the term."""
    return F.shiftrightunsigned(code, 64 - PART_BITS)


def finest(found: Column) -> Column:
    """(part, hash) in one number for each part with a term. `found` is a sorted array of codes, so a part's finest one is its first."""
    firsts = F.filter(found, lambda t, i: (i == 0) | (part_of(t) != part_of(F.get(found, i - 1))))
    return F.transform(firsts, lambda t: F.shiftleft(part_of(t), 4 * DIGITS) + t.bitwiseAND((1 << 4 * DIGITS) - 1))


def with_print(df: DataFrame, content: str, name: str, common: Column) -> DataFrame:
    """`name` takes the fingerprint of the text in `content`, `name`_parts the numbers of its parts. A text without terms in the
    lexicon has a hash of all its terms, or of its signs where there is no term, and no part, so that it is like its
    equals only; all texts of white space are equal."""
    df = df.withColumn("all_codes", codes(F.col(content))).withColumn("found", F.sort_array(F.array_except("all_codes", common)))
    signs = F.regexp_replace(content, "[\\s\\p{Z}]+", "")
    whole = F.when(F.size("found") > 0, F.xxhash64("found")).when(F.size("all_codes") > 0, F.xxhash64(F.sort_array("all_codes"))).otherwise(F.xxhash64(signs))
    df = df.withColumn("whole", whole).withColumn(f"{name}_parts", finest(F.col("found")))
    written = F.array_join(F.transform(f"{name}_parts", lambda p: F.lpad(F.hex(p), 2 + DIGITS, "0")), "")
    return df.withColumn(name, F.when(F.col(content).isNotNull(), F.lower(F.concat(hexadecimal(F.col("whole")), written)))).drop("all_codes", "found", "whole")


def likeness(a: Column, b: Column, a_parts: Column, b_parts: Column) -> Column:
    """Share of equal parts (0 to 1) among those in which either text has a term; without any, only equal fingerprints are alike."""
    def numbers(parts: Column) -> Column:
        return F.transform(parts, lambda p: F.shiftright(p, 4 * DIGITS))

    same, has = F.size(F.array_intersect(a_parts, b_parts)), F.size(F.array_union(numbers(a_parts), numbers(b_parts)))
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.try_divide(same.cast("double"), has.cast("double")), F.lit(0.0)))


# ------------------------------------------------------------------ the next document

def bucket_of(bounds: list[int]) -> Column:
    """Number of bounds at or below doc_id, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    held, steps = F.lit(bounds), [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
        (at + step <= len(bounds)) & (F.get(held, at + step - 1) <= F.col("doc_id")), at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def beside_next(docs: DataFrame) -> DataFrame:
    """(bucket, place, doc_id, text, next_text, last) of every row; next_text is that of the next row by doc_id, behind the
    last row of the table that of the first.

    Rows are dealt into ranges of doc_id of about equal size, in which windows find the neighbour; the last row of a
    range gets the first text of the next range by a join that keeps this partitioning. Null doc_ids come first; rows
    with the same doc_id are ordered by their text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ranges = RANGES_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least, found = texts.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()
    bounds = sorted(set(found or []) - {least})  # each bound is a doc_id of its range, the least one of the first: no range is empty
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    ordered = texts.withColumn("bucket", bucket_of(bounds)).select(
        "bucket", F.row_number().over(order).alias("place"), "doc_id", "text", F.lead("text").over(order).alias("following"))
    firsts = ordered.where("place = 1").select(
        F.pmod(F.col("bucket") - 1, F.lit(len(bounds) + 1)).alias("bucket"), F.col("text").alias("first_text"))
    # both sides read the one shuffle of the texts; only the last row of a range takes the other side's text
    joined = ordered.alias("o").join(firsts.hint("merge").alias("f"), (F.col("o.bucket") == F.col("f.bucket")) & F.col("following").isNull(), "left")
    return joined.select("o.bucket", "place", "doc_id", "text", F.coalesce("following", "first_text").alias("next_text"),
                         F.col("following").isNull().alias("last"))


# ------------------------------------------------------------------ fingerprints of all documents

def imatch(docs: DataFrame, least_idf: float = LEAST_IDF) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of `docs`
    (doc_id, text).

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, by ascending doc_id; the last is followed by the first, a single one by itself. Null texts count as
    empty. Equal texts have equal fingerprints. Rows that repeat come back as often as they occur; null doc_ids come
    first; other columns are ignored.
    """
    common = common_codes(docs, least_idf)
    half = F.floor(F.length("text") / 2).cast("int")
    printed = beside_next(docs).select(
        "bucket", "place", "doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("last"), F.col("next_text")).alias("wrapped_text"),
        F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    for content, name in (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("wrapped_text", "wrapped")):
        printed = with_print(printed, content, name, common)
    flat = printed.select("bucket", "place", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[
        f"{name}{kind}" for name in ("fingerprint", "edited_fingerprint", "wrapped") for kind in ("", "_parts")])
    order = Window.partitionBy("bucket").orderBy("place")
    following = {kind: F.coalesce(F.lead(f"fingerprint{kind}").over(order), F.col(f"wrapped{kind}")) for kind in ("", "_parts")}
    beside = flat.withColumns({f"following{kind}": column for kind, column in following.items()})
    own, edited, after = ((F.col(name), F.col(f"{name}_parts")) for name in ("fingerprint", "edited_fingerprint", "following"))
    return beside.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                         likeness(own[0], edited[0], own[1], edited[1]).alias("near_edited"),
                         likeness(own[0], after[0], own[1], after[1]).alias("near_next"))
