"""Mixing sources to target weights by Poisson replication.

Every document is repeated k times, k drawn from a Poisson distribution whose mean is
its source's target repetition rate, by inverting the distribution at a number that a
hash of seed and document id gives. The repeats are then put in a global random order.

A null source is a source of its own. Sources without a weight get none of the mixture.
Rows with equal ids get equal counts; null ids draw as the text "null". An empty table,
or weights that fit no source, give an empty mixture. The added columns replace columns
of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.columns import free_name

# Means above this are drawn as a sum of equal smaller ones, so that exp(-mean) keeps its precision.
MEAN_STEP = 64.0
# A rate table up to this many sources is small enough to send to every executor (about 2 KB a source).
BROADCAST_SOURCES = 10_000


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from a hash of the seed and the parts."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2 ... for means up to MEAN_STEP, far into the tail."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, temperature: float, size: float | None, source_col: str) -> DataFrame:
    """One row a source: source, n_docs, rate. ``weights`` are target shares; without them a share follows n_docs ** temperature."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weighted = counts.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(temperature)))
    else:
        weight = F.lit(0.0)
        for source, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(value))).otherwise(weight)
        weighted = counts.withColumn("weight", weight)
    total = weighted.agg(F.sum("n_docs").alias("n"), F.sum("weight").alias("w")).first()
    wanted = float(total.n or 0) if size is None else size
    rate = F.lit(wanted) * F.col("weight") / F.lit(float(total.w or 1.0)) / F.col("n_docs")
    return weighted.select("source", "n_docs", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, size: float | None = None,
                seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Documents with n_copies and copy_no (from 1), in the order of the random key ``mix_key``. ``size``: mean rows of the mixture, as many as there are documents if not given."""
    rates = source_rates(docs, weights, temperature, size, source_col)
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_STEP)).cast("int")
    own, drawn, cdf = (free_name(docs, name) for name in ("_source", "_draws", "_cdf"))
    table = rates.select(F.col("source").alias(own), draws.alias(drawn), poisson_table(F.col("rate") / draws).alias(cdf))
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)  # else the planner joins by shuffle, where a hot source is split at run time
    joined = docs.join(table, docs[source_col].eqNullSafe(table[own]))
    one = F.transform(F.sequence(F.lit(1), F.col(drawn)), lambda i: F.size(F.filter(cdf, lambda c: c <= uniform(seed, F.col(id_col), i))))
    counted = joined.withColumn("n_copies", F.aggregate(one, F.lit(0), lambda a, b: a + b)).where("n_copies > 0").drop(own, drawn, cdf)
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed + "-order"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy_no").cast("string"))))
    return keyed.orderBy("mix_key")
