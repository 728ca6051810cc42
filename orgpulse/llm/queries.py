"""One query for each operator over its whole table, and its SQL where SQL can state the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.llm import bpe, fingerprints, hard_negatives, ngram_join, pii, poisson_mix, simhash, suffix_dedup, token_alignment, toxicity, url_cascade, vector_search, warc
from orgpulse.session import ensure_checkpoint_dir

PII_KEY = "surrogates-1"
MIX_SEED = "mix-1"
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50, with_text=False)


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"), words=3, percent=90)


def surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    written = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edited(table(spark, sf_dir, "documents"))


def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text")


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), seed=MIX_SEED)


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, rank_path(), public_tokenizers.PATTERN).drop("text")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a rule are blocked if their host is listed; hosts whose MD5 begins with 0 or 1 stand for a bought list."""
    judged = url_cascade.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, F.substring(F.md5("key"), 1, 1).isin("0", "1"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_documents(table(spark, sf_dir, "documents"), words=3, radius=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": repeats,
    "op2_ngram_jaccard": near_copies,
    "op3_pii_surrogates": surrogates,
    "op4_warc_dictionary": archives,
    "op5_fingerprints": sketches,
    "op6_toxicity": severities,
    "op7_poisson_mix": mixture,
    "op8_posting_lists": neighbours,
    "op9_byte_bpe": tokens,
    "op10_url_cascade": verdicts,
    "op11_hard_negatives": negatives,
    "op12_token_alignment": alignments,
    "op13_simhash_planes": simhash_groups,
}

SQL: dict[str, str] = {
    "op4_warc_dictionary": """
        WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
        k AS (SELECT *, sha256(payload) AS content FROM p),
        top AS (SELECT content, max(page_id) AS last FROM k WHERE octet_length(payload) >= 1000 GROUP BY content)
        SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < last THEN last END AS refers_to, coalesce(url, '') AS url
        FROM k LEFT JOIN top ON k.content = top.content AND octet_length(payload) >= 1000""",
    "op7_poisson_mix": """
        WITH c AS (SELECT source, count(*) AS n_docs, pow(CAST(count(*) AS DOUBLE), 0.5) AS weight FROM documents GROUP BY source),
        r AS (SELECT source, (SELECT sum(n_docs) FROM c) * weight / (SELECT sum(weight) FROM c) / n_docs AS rate FROM c),
        m AS (SELECT *, CAST(greatest(1, ceil(rate / 64.0)) AS INT) AS draws FROM r),
        u AS (SELECT d.doc_id, d.source, d.text, m.rate / m.draws AS mean, i,
                     CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '|' || i), 1, 13) AS BIGINT) / 4503599627370496.0 AS drawn
              FROM documents d JOIN m ON d.source IS NOT DISTINCT FROM m.source, unnest(range(1, m.draws + 1)) AS x(i)),
        steps AS (SELECT u.*, list_reduce(list_prepend({'p': exp(-mean), 'cdf': exp(-mean), 'n': 0, 'k': CASE WHEN exp(-mean) <= drawn THEN 1 ELSE 0 END},
                     list_transform(range(1, CAST(ceil(mean + 12 * sqrt(mean) + 24) AS BIGINT) + 1), lambda k: {'p': 0.0, 'cdf': 0.0, 'n': CAST(k AS INT), 'k': 0})),
                     lambda a, b: {'p': a.p * mean / b.n, 'cdf': a.cdf + a.p * mean / b.n, 'n': b.n, 'k': a.k + CASE WHEN a.cdf + a.p * mean / b.n <= drawn THEN 1 ELSE 0 END}).k AS k FROM u),
        n AS (SELECT doc_id, source, text, CAST(sum(k) AS INT) AS n_copies FROM steps GROUP BY doc_id, source, text)
        SELECT doc_id, source, text, n_copies, CAST(j AS INT) AS copy_no,
               md5('mix-1-order|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || j) AS mix_key
        FROM n, unnest(range(1, n_copies + 1)) AS x(j)""",
    "op10_url_cascade": """
        WITH p AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM p),
        rules(rule, host_part, path_part, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
            ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
        m AS (SELECT s.*, (SELECT max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) FROM rules r
                           WHERE (s.host = r.host_part OR ends_with(s.host, '.' || r.host_part)) AND starts_with(s.path, r.path_part)) AS hit FROM s)
        SELECT page_id, host, path, hit.rule AS rule,
               coalesce(hit.verdict, CASE WHEN substr(md5(host), 1, 1) IN ('0', '1') THEN 'block' ELSE 'allow' END) AS verdict FROM m""",
    "op11_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
              FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5""",
}
