"""Queries of the numbered operators with production parameters, and their DuckDB forms where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalox.llm.ann import nearest
from catalox.llm.exact_dedup import exact_dedup
from catalox.llm.extraction import extract
from catalox.llm.line_dedup import line_dedup, line_digest
from catalox.llm.mixing import mix
from catalox.llm.near_dedup import near_dedup
from catalox.llm.packing import pack
from catalox.llm.quality import classify
from catalox.llm.substring_dedup import substring_dedup, substring_digest
from catalox.llm.warc import capture_histories


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(substring_dedup(_table(spark, sf_dir, "documents")))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(line_dedup(_table(spark, sf_dir, "documents")))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), shingle=4)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_histories(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op8_adaptive_scan_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_warc_index_merge": op6_warc_index_merge,
    "op7_html_extraction": op7_html_extraction,
    "op8_adaptive_scan_ann": op8_adaptive_scan_ann,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS x FROM p),
        m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first_id FROM g),
        gone AS (SELECT DISTINCT doc_id, i + j AS k FROM m, range(0, 13) t(j) WHERE first_id < doc_id),
        words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w),
        kept AS (
            SELECT words.doc_id, count(*) AS n_words, count(gone.k) AS n_removed,
                   coalesce(string_agg(word, ' ' ORDER BY words.k) FILTER (gone.k IS NULL), '') AS t
            FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k GROUP BY words.doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op2_source_mixing": r"""
        WITH f AS (
            SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS tokens
            FROM documents),
        d AS (SELECT *, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'core' ELSE 'tail' END AS domain FROM f WHERE tokens > 0),
        l3 AS (SELECT domain, lang, source, sum(tokens)::DOUBLE AS n, sum(tokens)::DOUBLE * 4 AS cap, CASE source WHEN 'src0' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
               FROM d GROUP BY ALL),
        l2 AS (SELECT domain, lang, sum(cap) AS cap,
                      CASE lang WHEN 'en' THEN 5.0::DOUBLE WHEN 'de' THEN 2.0::DOUBLE WHEN 'fr' THEN 2.0::DOUBLE WHEN 'es' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
               FROM l3 GROUP BY ALL),
        l1 AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'core' THEN 3.0::DOUBLE WHEN 'tail' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
               FROM l2 GROUP BY ALL),
        b AS (SELECT floor(sum(n)::DOUBLE * 0.8) AS share FROM l3),
        a1 AS (SELECT domain, cap, w, share,
                      (share - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv
               FROM l1, b),
        p1 AS (SELECT domain, coalesce(least(cap, w * max(lv) FILTER (lv * w <= cap) OVER ()), cap) AS share FROM a1),
        a2 AS (SELECT domain, lang, cap, w,
                      (share - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / (sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv
               FROM l2 JOIN p1 USING (domain)),
        p2 AS (SELECT domain, lang, coalesce(least(cap, w * max(lv) FILTER (lv * w <= cap) OVER (PARTITION BY domain)), cap) AS share FROM a2),
        a3 AS (SELECT domain, lang, source, n, cap, w,
                      (share - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / (sum(w) OVER (PARTITION BY domain, lang) - coalesce(sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv
               FROM l3 JOIN p2 USING (domain, lang)),
        p3 AS (SELECT domain, lang, source, n::BIGINT AS leaf_tokens,
                      floor(coalesce(least(cap, w * max(lv) FILTER (lv * w <= cap) OVER (PARTITION BY domain, lang)), cap) + 1e-6)::BIGINT AS part
               FROM a3),
        e AS (SELECT d.doc_id, d.domain, d.lang, d.source, d.tokens, part, leaf_tokens, unnest(range(0, (part - 1) // leaf_tokens + 1)) AS epoch
              FROM d JOIN p3 ON d.domain = p3.domain AND d.lang = p3.lang AND d.source = p3.source WHERE part > 0),
        o AS (SELECT *, part - epoch * leaf_tokens AS left_,
                     coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5(concat('17|', epoch, '|', doc_id)), doc_id
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_token
              FROM e)
        SELECT doc_id, domain, lang, source, epoch::INT AS epoch, tokens,
               CASE WHEN left_ < leaf_tokens THEN first_token END AS first_token,
               CASE WHEN left_ < leaf_tokens THEN least(tokens, left_ - first_token) ELSE tokens END AS taken
        FROM o WHERE left_ >= leaf_tokens OR first_token < left_""",
    "op3_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
                  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
        frequent AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
        marked AS (SELECT l.*, f.k IS NOT NULL AS gone FROM lines l LEFT JOIN frequent f ON l.k = f.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op4_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        g AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT g.b, r.c FROM r JOIN g ON r.id = g.a),
        m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
        SELECT s.doc_id, len(sh) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept FROM s JOIN m ON m.id = s.doc_id""",
    "op6_warc_index_merge": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        m AS (SELECT page_id, h, n, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS f FROM p)
        SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN f > page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f > page_id THEN f END AS refers_to
        FROM m""",
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
}
