"""The queries of the text operators: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from . import (bpe, digest_index, fingerprints, hard_negatives, html_blocks, language, line_dedup, merkle, packing, records,
               simhash, token_counts, toxicity)
from .common import table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), end_id=2, capacity=1024)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_file_digest(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), end_id=1)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def fresh_index(spark: SparkSession) -> digest_index.DigestIndex:
    """An empty index of its own, so that a query's result depends on its tables alone."""
    return digest_index.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", new_folder(spark, "digest_index"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.deduplicate(table(spark, sf_dir, "documents"), fresh_index(spark))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.imatch(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), limit=1024)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"), least_documents=10, least_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_simhash, op3_language, op4_records, op5_toxicity, op6_exact_dedup, op7_imatch,
                            op8_token_counts, op9_bpe, op10_html, op11_merkle, op12_hard_negatives, op13_line_dedup)
}


# CRC-32 of the decimal doc_id, bit by bit
CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
             lambda c: list_transform(range(8), lambda i: (ascii(c) >> i) & 1)))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))"""


def merkle_sql(levels: int = 7, group_levels: int = 3) -> str:
    """The manifest in SQL: a chain of common table expressions, one for each level of the groups' trees (up to 8 to the
    power of `levels` leaves) and of the tree over the groups."""
    def field(column: str) -> str:
        return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column}::VARCHAR END"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join([*map(field, ('doc_id', 'source', 'lang', 'n_chars')), field(text)])})"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = [f"""claimed AS (
        SELECT doc_id, coalesce('=' || lang, '-') AS grp, {leaf("text")} AS leaf, {leaf("bent")} AS claim
        FROM (SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, '{upper}', '{lower}') ELSE text END AS bent
              FROM (SELECT *, {CRC_SQL} AS crc FROM documents))),
      placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM claimed),
      up0 AS (SELECT grp, place, leaf AS digest, count(*) OVER (PARTITION BY grp) AS n FROM placed)"""]
    for k in range(levels):
        parts.append(f"""up{k + 1} AS (
        SELECT grp, place, digest, count(*) OVER (PARTITION BY grp) AS n
        FROM (SELECT grp, place // 8 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM up{k} WHERE n > 1 GROUP BY ALL))""")
    tops = " UNION ALL ".join(f"SELECT grp, digest AS subroot FROM up{k} WHERE n = 1" for k in range(levels + 1))
    parts.append(f"""subroots AS ({tops}),
      head0 AS (SELECT grp AS of_grp, subroot AS digest, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM subroots)""")
    for k in range(group_levels):
        parts.append(f"""head{k + 1} AS (
        SELECT place, digest, count(*) OVER () AS n
        FROM (SELECT place // 8 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM head{k} WHERE n > 1 GROUP BY ALL))""")
    roots = " UNION ALL ".join(f"SELECT digest AS root FROM head{k} WHERE n = 1" for k in range(group_levels + 1))
    parts.append(f"roots AS ({roots}), walk0 AS (SELECT doc_id, grp, place AS row_place, place, leaf, claim AS now, '' AS proof FROM placed)")

    def step(new: str, old: str, level: str, keys: str, place: str) -> str:
        on = " AND ".join([f"u.{place} // 8 = w.place // 8", *([f"u.{keys} = w.{keys}"] if keys else [])])
        return f"""{new} AS (
        SELECT doc_id, grp, row_place, CASE WHEN run_n IS NULL THEN place ELSE place // 8 END AS place, leaf,
               CASE WHEN run_n IS NULL THEN now ELSE sha256(folded) END AS now, proof || coalesce(others, '') AS proof
        FROM (SELECT w.doc_id, w.grp, w.row_place, w.place, w.leaf, w.now, w.proof, max(u.n) AS run_n,
                     string_agg(CASE WHEN u.place = w.place THEN w.now ELSE u.digest END, '' ORDER BY u.place) AS folded,
                     string_agg(CASE WHEN u.place <> w.place THEN u.digest END, '' ORDER BY u.place) AS others
              FROM {old} w LEFT JOIN {level} u ON u.n > 1 AND {on} GROUP BY ALL))"""

    for k in range(levels):
        parts.append(step(f"walk{k + 1}", f"walk{k}", f"up{k}", "grp", "place"))
    parts.append(f"""headed0 AS (SELECT w.doc_id, w.grp, w.row_place, h.place, w.leaf, w.now, w.proof
                      FROM walk{levels} w JOIN head0 h ON h.of_grp = w.grp)""")
    for k in range(group_levels):
        parts.append(step(f"headed{k + 1}", f"headed{k}", f"head{k}", "", "place"))
    return f"""WITH {', '.join(parts)}
      SELECT w.doc_id, w.leaf, s.subroot, r.root, sha256(w.proof) AS proof_sha256, w.now AS folded_root, w.now = r.root AS verified
      FROM headed{group_levels} w JOIN subroots s ON s.grp = w.grp CROSS JOIN roots r"""

LINE_SQL = """
    WITH cut AS (SELECT row_number() OVER () AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
      line AS (SELECT doc, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM cut),
      keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
      gone AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc) >= 10),
      kept AS (SELECT doc, count(*) AS n_lines, count(gone.k) AS n_dropped,
                      coalesce(string_agg(CASE WHEN gone.k IS NULL THEN line END, chr(10) ORDER BY place), '') AS text
               FROM keyed LEFT JOIN gone ON gone.k = keyed.k GROUP BY doc)
    SELECT doc_id, n_lines, n_dropped, sha256(kept.text) AS kept_sha256 FROM cut JOIN kept USING (doc)"""

NEGATIVES_SQL = """
    WITH vec AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS codes
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      pair AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.codes, b.codes)::BIGINT AS score
               FROM vec a JOIN vec b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
      positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.positive_id, row_number() OVER best AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
    FROM positive p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same
         AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
    WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
    QUALIFY row_number() OVER best <= 10"""

ORACLE = {
    "op6_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
                     max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
                     count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
              FROM documents)""",
    "op11_merkle": merkle_sql(),
    "op12_hard_negatives": NEGATIVES_SQL,
    "op13_line_dedup": LINE_SQL,
}
