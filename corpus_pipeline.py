"""Documents to token ids: toxic documents go, one of each group of near copies stays, personal data
gets surrogates, sources are mixed to their target weights, and the mixture is encoded.

Each stage is written as Parquet in the folder of spark.checkpoint.dir and read again by the next.

Null, empty and blank texts pass all stages, each row of them, and have no tokens. Rows without an
id are compared like others and stay if no row with an id is a near copy of them. Of repeated rows
one stays. Rows without a source are a source of their own. Very long texts are whole in all
stages. An empty table gives an empty result. Other columns of documents are dropped.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.llm import bpe, ngram_join, pii, poisson_mix, toxicity
from orgpulse.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PII_KEY = "surrogates-1"
MIX_SEED = "mix-1"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("NOT rejected").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by five-word shingles at a Jaccard similarity of 0.8 or more, one row stays: that of the smallest doc_id."""
    return ngram_join.keep_one(docs, words=5, percent=80).select(*COLUMNS)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates can be longer or shorter than what they stand for, so n_chars is counted anew."""
    replaced = pii.replace_pii(docs, PII_KEY)
    return replaced.withColumn("n_chars", F.when(F.col("n_pii") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return poisson_mix.mix_sources(docs, seed=MIX_SEED).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (array<int>) in place of the text, their number, and the digests of ids and decoded bytes to check them by."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN, digests=True).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", replace_pii),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

# A fitted model, a similarity join and tokens are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
