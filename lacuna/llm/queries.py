"""Registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import codes, decontam, exact_dedup, htmltext, huffman, langid, lm, negatives, packing, secrets, sharding, simhash, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(_table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", F.col("group_error").alias("label_error"), F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("vec_id")
    label = F.when(n % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), n % 100 == 0)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_exact_dedup,
        op3_simhash,
        op4_token_ids,
        op5_decontamination,
        op6_language_id,
        op7_url_filter,
        op8_lm_scoring,
        op9_secret_scan,
        op10_html_extraction,
        op11_vector_codes,
        op12_hard_negatives,
        op13_sharding,
    )
}

FINITE = "embedding IS NOT NULL AND NOT list_bool_or([NOT coalesce(isfinite(x), false) FOR x IN embedding])"


def _assigned(k: int) -> str:
    """Nearest entry of each part under codebook k."""
    return f"""a{k} AS MATERIALIZED (SELECT vec_id, label, j, arg_min(e, row(d, e)) AS e, min(d) AS d FROM (
        SELECT p.vec_id, p.label, p.j, c.e, list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v) AS d FROM p JOIN c{k} c ON c.j = p.j) GROUP BY 1, 2, 3)"""


def _updated(k: int) -> str:
    """Codebook k + 1: floors of the means, unused entries as they were."""
    return f"""m{k} AS (SELECT j, e, list(m ORDER BY i) AS v FROM (SELECT a.j, a.e, i, floor(sum(p.v[i]) / count(*)) AS m FROM a{k} a JOIN p USING (vec_id, j), range(1, 17) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    c{k + 1} AS MATERIALIZED (SELECT c.j, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON m.j = c.j AND m.e = c.e)"""


CODES = f"""WITH p AS MATERIALIZED (SELECT vec_id, label, j, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding[j * 16 + 1 : j * 16 + 16]] AS v FROM embeddings, range(4) t(j) WHERE {FINITE} AND len(embedding) = 64),
    c0 AS MATERIALIZED (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, v FROM p QUALIFY e < 256),
    {", ".join(f"{_assigned(k)}, {_updated(k)}" for k in range(4))}, {_assigned(4)},
    books AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY j, e, i)) AS codebooks_sha256 FROM (SELECT j, e, i, v[i] AS x FROM c4, range(1, 17) t(i))),
    coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY j) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY 1, 2)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books"""

ORACLES = {
    "op11_vector_codes": CODES,
    "op12_hard_negatives": f"""
        WITH k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings WHERE label IS NOT NULL AND {FINITE}),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM k a JOIN k b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
    """,
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """,
    "op7_url_filter": r"""
        WITH u AS (
            SELECT page_id,
                translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
            FROM pages),
        rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        fit AS (
            SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
            FROM (SELECT DISTINCT page_id, host, path FROM u) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT u.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
            coalesce(verdict, CASE WHEN coalesce(host, '') = '' OR regexp_matches(host, 'casino|pills|bets|spam|porn|viagra|poker|warez|torrent|malware|phish|escort')
                OR regexp_matches(host, '^(ads?|adserver|banners?|click|doubleclick|pixel|track|tracker|tracking)\.')
                OR regexp_matches(path, '(/wp-login\.php|/xmlrpc\.php|/login|/signin|\.(apk|css|exe|gif|ico|iso|jpeg|jpg|js|mp3|mp4|png|svg|zip))$|/(wp-admin|cgi-bin|login|signin|cart|checkout)/') THEN 'block' ELSE 'allow' END) AS verdict
        FROM u LEFT JOIN fit USING (page_id)
    """,
}
