"""The queries of this subpackage by name, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kvspark.llm import ann, bpe, media, ngram_join, packing, quality, sharding, substring, toxicity, urlfilter
from kvspark.llm._common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeat_digest(table(spark, sf_dir, "documents"), window=20)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_links(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op3_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bitmap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, added=True)


def op7_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op8_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.telephony_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_nb_svm": op3_nb_svm,
        "op4_kneser_ney": op4_kneser_ney,
        "op5_bitmap_bpe": op5_bitmap_bpe,
        "op6_tiered_packing": op6_tiered_packing,
        "op7_link_graph": op7_link_graph,
        "op8_hash_ring": op8_hash_ring,
        "op9_pruned_graph": op9_pruned_graph,
        "op10_telephony": op10_telephony,
    }


WORDS = r"regexp_extract_all(%s, '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS % "coalesce(text, '')"} AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS j FROM w),
s AS (SELECT doc_id, j, string_agg(word, ' ') OVER v AS g, count(*) OVER v AS c FROM x
      WINDOW v AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, j AS i, row_number() OVER (PARTITION BY g ORDER BY doc_id, j) AS rn FROM s WHERE c = 20),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE rn > 1),
k AS (SELECT x.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY j) AS kept
      FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND r.j = x.j) GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

OP2_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS % "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 3], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(greatest(1, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id,
       CAST((SELECT count(*) FROM e WHERE e.a = w.doc_id) AS BIGINT) AS n_links
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id
"""

def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1_SQL,
        "op2_ngram_jaccard": OP2_SQL,
        "op7_link_graph": urlfilter.judge_sql(),
    }
