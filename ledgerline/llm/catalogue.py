"""Queries of the training-data operators: one ``opN_<name>`` each, over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import audio, decontaminate, language, neardup, packing, parsing, pii, quality, sharding, substring
from ledgerline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicates(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assignment(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.deduplicated(table(spark, sf_dir, "documents"))


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.scores(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_best_fit_packing, op3_substring_dedup, op4_sharding, op5_suffix_array_dedup, op6_audio_features, op7_quality_classifier, op8_language_model, op9_decontamination, op10_pii)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB SQL of the queries that SQL can state; the others are tested against brute force in tests/llm.
ORACLES = {
    "op1_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
        r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node),
        e AS (SELECT a, min(b) AS b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE shared = p.n AND shared = q.n GROUP BY a),
        f AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
        SELECT f.doc_id, coalesce(n, 0) AS n_shingles, component_id, f.doc_id = component_id AS kept, least(f.doc_id, coalesce(e.b, f.doc_id)) AS class_id
        FROM f LEFT JOIN n USING (doc_id) LEFT JOIN e ON e.a = f.doc_id""",
    "op3_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)),
        r AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
        c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS k FROM g SEMI JOIN r USING (s)),
        x AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS k FROM w),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM x ANTI JOIN c USING (doc_id, k) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op9_decontamination": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        p AS (SELECT DISTINCT item, least(8, len(ws)) AS size, array_to_string(ws[i : i + 7], ' ') AS s FROM (SELECT item, ws, unnest(generate_series(1, greatest(1, len(ws) - 7))) AS i FROM b WHERE len(ws) > 0)),
        z AS (SELECT DISTINCT size FROM p),
        g AS (SELECT doc_id, i, size, array_to_string(ws[i : i + size - 1], ' ') AS s FROM (SELECT doc_id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM w, z WHERE len(ws) >= size)),
        h AS (SELECT doc_id, i, size, item FROM g JOIN p USING (s, size)),
        c AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS k FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(t.n, 0) >= 2 AS contaminated
        FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
