"""The queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchops.llm import (bpe, divergence, fingerprints, hard_negatives, language, licenses, near_dups, packing, sharding, token_counts,
                          topk, toxicity, warc)
from matchops.llm.common import table
from matchops.session import work_dir


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoding."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"), *vocabulary)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    return sharding.shard_bytes(table(spark, sf_dir, "documents"), shards=16)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.identify(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    counted = token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with like fingerprints."""
    return fingerprints.near_pairs(fingerprints.fingerprint_edits(table(spark, sf_dir, "documents")))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every hundredth vector, against all others."""
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over shingles of four words."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=4, threshold=0.8)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives for the five best positives of every hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, 256)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ARC files of both versions, converted to WARC files and read back."""
    pages, folder = table(spark, sf_dir, "pages"), work_dir(spark, "archives")
    for version in (1, 2):
        half = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(2)) == version - 1)
        warc.write_arc(half, f"{folder}/arc/v{version}", version)
    warc.write_warc(warc.with_revisits(warc.convert(spark, f"{folder}/arc/v*"), least=1000), f"{folder}/warc")
    return warc.resolved(warc.read_warc(spark, f"{folder}/warc")).withColumnRenamed("item", "page_id")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of each language, by pair and by term."""
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=30, most_terms=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_bpe": op3_bpe,
    "op4_sharding": op4_sharding,
    "op5_language": op5_language,
    "op6_token_counts": op6_token_counts,
    "op7_licenses": op7_licenses,
    "op8_fingerprints": op8_fingerprints,
    "op8_near_pairs": op8_near_pairs,
    "op9_topk": op9_topk,
    "op10_near_dups": op10_near_dups,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_warc": op12_warc,
    "op13_divergence": op13_divergence,
}
SQL: dict[str, str] = {
    "op9_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_near_dups": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
          FROM documents),
        s AS (
          SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
                              WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                              ELSE list_distinct(list_transform(range(1, len(ws) - 2),
                                     lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
          FROM w),
        n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
        u AS (SELECT doc_id, unnest(sh) AS g FROM s),
        links AS (
          SELECT a.doc_id AS a, b.doc_id AS b
          FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id
          JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n_shingles, nb.n_shingles
          HAVING 100 * count(*) >= 80 * (na.n_shingles + nb.n_shingles - count(*))),
        reach AS (
          SELECT doc_id AS node, doc_id AS root FROM n
          UNION
          SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node)
        SELECT n.doc_id, CAST(n.n_shingles AS BIGINT) AS n_shingles, min(r.root) AS component_id,
               n.doc_id = min(r.root) AS kept
        FROM n JOIN reach r ON r.node = n.doc_id
        GROUP BY n.doc_id, n.n_shingles""",
    "op11_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                 CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
          FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
        p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        r AS (
          SELECT p.anchor_id, p.positive_id,
                 CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank,
                 s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
          FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
            AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score)
        SELECT * FROM r WHERE rank <= 10""",
    "op12_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        r AS (
          SELECT *, row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS nth,
                 max(page_id) OVER (PARTITION BY payload) AS first
          FROM p)
        SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN strlen(payload) >= 1000 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(payload) >= 1000 AND nth > 1 THEN first END AS refers_to
        FROM r""",
    "op13_divergence": r"""
        WITH d AS (
          SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
          FROM documents),
        kept AS (
          SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ws)) AS term FROM d)
          GROUP BY lang, term HAVING count(*) >= 30),
        c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        dense AS (
          SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n
          FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
        s AS (
          SELECT *, sum(n) OVER (PARTITION BY lang, source) AS gn, count(*) OVER (PARTITION BY lang, source) AS v,
                 sum(n) OVER (PARTITION BY lang, term) AS ln, sum(n) OVER (PARTITION BY lang) AS lt
          FROM dense),
        p AS (
          SELECT lang, source, term, n,
                 CAST(1 + CAST(1000000000 AS HUGEINT) * (CAST(n AS HUGEINT) + 5) // (gn + 5 * v) AS BIGINT) AS p,
                 CAST(1 + CAST(1000000000 AS HUGEINT) * (CAST(ln AS HUGEINT) + 5) // (lt + 5 * v) AS BIGINT) AS q
          FROM s),
        pair AS (
          SELECT a.lang, a.source, b.source AS item, sum(abs(pa.p - pb.p)) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p pa ON pa.lang = a.lang AND pa.source = a.source
          LEFT JOIN p pb ON pb.lang = b.lang AND pb.source = b.source AND pb.term = pa.term
          GROUP BY ALL),
        rows AS (
          SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM pair
          UNION ALL
          SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
        FROM rows QUALIFY part = 'pair' OR rank <= 50""",
}
