"""One registered query per operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, langid, packing, phrases, quality, simhash, sketch, spans, tokenfile, topk, urlfilter, warc
from .shared import documents, scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

SITE_RULES = [
    urlfilter.site_rule("allow", "org", "/"),
    urlfilter.site_rule("block", "example.org", "/es/"),
    urlfilter.site_rule("block", "example.org", "/en/1"),
    urlfilter.site_rule("allow", "com", "/fr/"),
    urlfilter.site_rule("block", "com", "/de/"),
]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = scratch_path(spark, "archives")
    warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), archives, min_bytes=0)
    return warc.page_records(warc.read_archives(spark, archives, payload="digest"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = scratch_path(spark, "token-ids")
    tokenfile.write(documents(spark, sf_dir), files, VOCABULARY, end_id=2)
    return tokenfile.read(spark, files, ids=False).drop("ids")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = spans.dedup_substrings(documents(spark, sf_dir))
    return cleaned.select("doc_id", "text", "n_sentences", "n_removed", "source_ids")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), radius=2, shingle=3)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), VOCABULARY, size=1024, end_id=2)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urlfilter.judge(pages, [*SITE_RULES, *urlfilter.PATTERNS]).select("page_id", "host", "path", "rule", "verdict")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir), least=30, depth=4, cover=80, keep=2000)


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = sketch.edited_fingerprints(documents(spark, sf_dir))
    own, edited = F.col("sketch"), F.col("edited_sketch")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch.fingerprint(own).alias("fingerprint"),
        sketch.fingerprint(edited).alias("edited_fingerprint"), sketch.containment(own, edited).alias("near_edited"),
        sketch.containment(own, F.col("next_sketch")).alias("near_next"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(documents(spark, sf_dir), percent=90, spm_percent=20, salt="1:")
    back = fim.restored_pieces(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", fim.piece_hash(F.col("text"), F.col("pieces")).alias("output_sha256"),
        fim.piece_hash(F.col("output"), back).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_token_ids, op3_substring_dedup, op4_simhash_near_dedup, op5_best_fit_packing, op6_url_filter,
        op7_exact_top_k, op8_benchmark_decontamination, op9_language_id,
        op10_quality_classifier, op11_phrase_collocations, op12_document_fingerprints, op13_fill_in_middle,
    )
}

ORACLE_SQL = {
    "op1_warc": r"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), named AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest
  FROM hashed
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to, CASE WHEN page_id = keeper THEN TRUE END AS digest_ok
FROM named""",
    "op7_exact_top_k": r"""
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), ranked AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY a.uid ORDER BY list_inner_product(a.q, b.q) DESC, b.vec_id) AS rank
  FROM v a JOIN v b ON a.uid <> b.uid AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op6_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), ruled AS (
  SELECT *, host = 'org' OR ends_with(host, '.org') AS org, host = 'com' OR ends_with(host, '.com') AS com,
         host = 'example.org' OR ends_with(host, '.example.org') AS example
  FROM parts
), named AS (
  SELECT *, CASE WHEN example AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN example AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN com AND starts_with(path, '/de/') THEN 'com/de/' WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN org AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM ruled
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host || path, '/(login|signup|cart|checkout|wp-login\.php|xmlrpc\.php)([^A-Za-z0-9]|$)') THEN 'block'
            WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])(casino|porn)([^A-Za-z0-9]|$)') THEN 'block'
            WHEN regexp_matches(host || path, '\.(zip|exe|iso)$') THEN 'block'
            WHEN regexp_matches(host || path, '^([^/]*\.)?(ads|tracker)\..*\.') THEN 'block' ELSE 'allow' END AS verdict
FROM named""",
    "op11_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, m, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4]) AS m))
), f AS (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
), sums AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30
), cuts AS (
  SELECT lang, m, phrase, a, w, k, list_aggregate(w[1:k], 'string_agg', ' ') AS one, list_aggregate(w[k + 1:m], 'string_agg', ' ') AS two
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.a) // (x.f + y.f) AS BIGINT) AS score, k
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.one JOIN f y ON y.lang = c.lang AND y.phrase = c.two
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, a, list_aggregate(w[i:i + s - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT lang, a, w, s, unnest(range(1, m - s + 2)) AS i FROM candidates, (SELECT unnest([2, 3]) AS s) WHERE s < m)
), around AS (
  SELECT lang, phrase, max(a) AS around FROM inner_phrases GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.around IS NULL OR 100::HUGEINT * o.around < 80::HUGEINT * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN sums USING (lang) QUALIFY rank <= 2000""",
    "op13_fill_in_middle": r"""
WITH numbered AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), drawn AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS d FROM numbered
), formed AS (
  SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) AS q,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, substr(t, 1, p) AS prefix, substr(t, p + 1, q - p) AS middle, substr(t, q + 1, n - q) AS suffix FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts""",
}
