"""Extra columns named like an operator's own ones are kept as they are and change no result."""

from pyspark.sql import functions as F

from orgpulse.llm import poisson_mix, toxicity, url_cascade
from orgpulse.llm.columns import free_name

OWN = ["_source", "_draws", "_CDF", "_judged", "_url", "_url_"]


def clashing(df):
    return df.select("*", *[F.lit(f"mine {c}").alias(c) for c in OWN])


def same(plain, extra):
    assert {tuple(r[c] for c in OWN) for r in extra.collect()} <= {tuple(f"mine {c}" for c in OWN)}
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, extra.drop(*OWN).collect()))


def test_free_names(spark):
    df = clashing(spark.range(1))
    assert [free_name(df, n) for n in ("_cdf", "_url", "id", "new")] == ["_cdf_", "_url__", "id_", "new"]


def test_mixing(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("source"))
    same(poisson_mix.mix_sources(docs), poisson_mix.mix_sources(clashing(docs)))
    same(poisson_mix.mix_sources(docs.limit(0)), poisson_mix.mix_sources(clashing(docs.limit(0))))


def test_toxicity(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2 > 0, "awful vile words ").otherwise("kind calm words "), F.col("id")).alias("text"))
    model = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    same(toxicity.score(docs, model), toxicity.score(clashing(docs), model))


def test_urls(spark):
    urls = ["http://a.example.org/es/x", "https://B.com/fr/?q", None, "no scheme", "http://example.org/en/1", "ftp://x.net#f"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = {"org/": "allow", "example.org/es/": "block"}
    listed = F.col("key").endswith(".net")
    same(url_cascade.judge_urls(pages, rules, listed), url_cascade.judge_urls(clashing(pages), rules, listed))
    renamed = pages.withColumnRenamed("url", "host")
    by_host = url_cascade.judge_urls(renamed, rules, listed, url_col="host").select("page_id", "host", "path", "rule", "verdict")
    same(url_cascade.judge_urls(pages, rules, listed).select(by_host.columns), clashing(by_host))
