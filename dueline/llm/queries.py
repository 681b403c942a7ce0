"""The operators on their whole tables, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dueline.llm import (
    bpe,
    cascade,
    crosspolytope,
    divergence,
    fingerprints,
    kdtree,
    langid,
    packing,
    prefix_trie,
    repair,
    simhash,
    substrings,
    warc,
)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
WORD_LEVEL = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _on(table: str, operator: Callable[[DataFrame], DataFrame]):
    return lambda spark, folder: operator(_read(spark, folder, table))


QUERIES = {
    "op1_fingerprint": _on("documents", fingerprints.compare_with_edits),
    "op2_byte_bpe": _on("documents", lambda d: bpe.round_trip(d, RANKS, public_tokenizers.PATTERN)),
    "op3_packing": _on("documents", lambda d: packing.packed(d, WORD_LEVEL)),
    "op4_sharding": _on("documents", kdtree.sharded),
    "op5_warc": _on("pages", warc.written_and_read),
    "op6_repair": _on(
        "documents", lambda d: repair.written_and_read(d, BYTE_LEVEL, public_tokenizers.PATTERN)
    ),
    "op7_suffix_dedup": _on("documents", substrings.digests),
    "op8_simhash": _on("documents", simhash.near_duplicates),
    "op9_cross_polytope": _on("embeddings", crosspolytope.near_duplicates),
    "op10_language_id": _on("documents", langid.identified),
    "op11_prefix_trie": _on("conversations", prefix_trie.families),
    "op12_quality_cascade": _on("documents", cascade.verdicts),
    "op13_source_divergence": _on("documents", divergence.audited),
}

SQL = {
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_quality_cascade": cascade.SQL,
    "op13_source_divergence": divergence.SQL,
    "op5_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100
                 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f""",
    "op9_cross_polytope": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e)
        / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON vec_id = least.a LEFT JOIN degree ON vec_id = degree.a""",
}
