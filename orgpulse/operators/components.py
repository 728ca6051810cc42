"""Grouping of accounts that share tokens, and the enrichment around it.

Input is (token, rid): an account ``rid`` (numeric) uses a ``token``. Accounts
linked through any chain of shared tokens form one group.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.functions.similarity import lastname_score
from orgpulse.operators.ordered import dense_rank_all
from orgpulse.session import cut_lineage

# Tokens that never link accounts, and the shortest usable username.
BLACKLIST = ["admin", "test", "bot", "root"]
SHORTEST_TOKEN = 4


def usable_tokens(pairs: DataFrame) -> DataFrame:
    """Drop generic tokens and too short usernames."""
    return pairs.where(~F.lower("token").isin(BLACKLIST) & (F.length("token") >= SHORTEST_TOKEN))


def identity_components(pairs: DataFrame, max_iter: int | None = None, rank: bool = True) -> DataFrame:
    """(rid, group_id, profile_group_id): smallest rid reachable through shared tokens.

    Each round takes the minimum per token, then per rid, then follows the
    group's own group (pointer jumping), so long chains halve instead of
    shrinking by one. Every step is an aggregate with map-side combine or a
    join against one row per key, so a token shared by a third of all accounts
    is split by AQE rather than collected. Stops when no group changes;
    with ``max_iter`` it raises if that many rounds were not enough.
    """
    links = cut_lineage(pairs.select("token", F.col("rid").cast("bigint").alias("rid")).distinct())
    # Tokens used by a single account link nothing; only shared ones take part in the rounds.
    shared = links.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("token")
    active = cut_lineage(links.join(shared, "token", "left_semi"))
    accounts = active.select("rid").distinct()
    groups = accounts.withColumn("group_id", F.col("rid"))
    for done in itertools.count(1):
        per_token = active.join(groups, "rid").groupBy("token").agg(F.min("group_id").alias("_low"))
        lowest = active.join(per_token, "token").groupBy("rid").agg(F.min("_low").alias("_low"))
        jump = lowest.select(F.col("rid").alias("_low"), F.col("_low").alias("_lower"))
        moved = lowest.join(jump, "_low", "left").select("rid", F.coalesce("_lower", "_low").alias("_next"))
        step = cut_lineage(
            groups.join(moved, "rid").select(
                "rid", F.least("_next", "group_id").alias("group_id"), (F.col("_next") < F.col("group_id")).alias("_changed")
            )
        )
        groups = step.select("rid", "group_id")
        if step.where("_changed").isEmpty():
            break
        if done == max_iter:
            raise RuntimeError(f"groups still change after {max_iter} rounds; raise max_iter")
    everyone = links.select("rid").distinct().join(groups, "rid", "left").withColumn("group_id", F.coalesce("group_id", "rid"))
    return dense_rank_all(everyone, "group_id", "profile_group_id") if rank else everyone


def merge_batch(groups: DataFrame, tokens: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a batch of new (token, rid) pairs changes in stored groups: rows (rid, group_id) and (token, group_id) to upsert.

    ``groups`` holds the group of every stored account, ``tokens`` that of every stored token; both may
    be empty. Only what the batch names takes part in the rounds: an account or token stands for its whole
    group, so the graph is as large as the batch, and only members of groups that merge are given back.
    The result is that of one run over all pairs, whatever the batches are.
    """
    pairs = cut_lineage(batch.select("token", F.col("rid").cast("bigint").alias("rid")).distinct())
    known = groups.select("rid", F.col("group_id").alias("_own")).join(pairs.select("rid").distinct(), "rid", "left_semi")
    seen = cut_lineage(tokens.select("token", F.col("group_id").alias("_theirs")).join(pairs.select("token").distinct(), "token", "left_semi"))
    # What is stored about the batch is looked up once; the rounds, the accounts and the tokens all need it.
    placed = cut_lineage(pairs.join(known, "rid", "left").withColumn("node", F.coalesce("_own", "rid")))
    # A token links what the batch says uses it, and the group that used it before.
    edges = placed.select("token", F.col("node").alias("rid")).unionByName(seen.select("token", F.col("_theirs").alias("rid")))
    moved = cut_lineage(identity_components(edges, rank=False).select(F.col("rid").alias("group_id"), F.col("group_id").alias("_new")))

    def regrouped(stored: DataFrame, key: str) -> DataFrame:
        shifted = moved.where(F.col("group_id") != F.col("_new"))
        return stored.select(key, "group_id").join(shifted, "group_id").select(key, F.col("_new").alias("group_id"))

    fresh = placed.select("rid", "token", F.col("node").alias("group_id"), F.col("_own").isNull().alias("_is_new")).join(moved, "group_id")
    accounts = fresh.where("_is_new").select("rid", F.col("_new").alias("group_id")).distinct().unionByName(regrouped(groups, "rid"))
    new_tokens = fresh.join(seen, "token", "left_anti").select("token", F.col("_new").alias("group_id")).distinct()
    return accounts, new_tokens.unionByName(regrouped(tokens, "token"))


def manual_bridges(pairs: DataFrame, manual: DataFrame) -> DataFrame:
    """Synthetic rows that give both tokens of a manual pair to the accounts using either."""
    both = manual.select(F.col("token_a").alias("token"), F.col("token_b").alias("other")).unionByName(
        manual.select(F.col("token_b").alias("token"), F.col("token_a").alias("other"))
    )
    return pairs.join(both, "token").select(F.col("other").alias("token"), "rid", F.lit("manual").alias("meta"))


def name_alias_pairs(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """A token holding a listed first name as a whole word gains the token with its alias; one direction only."""
    words = pairs.where(~F.contains("token", F.lit("@"))).withColumn("first_name", F.explode(F.array_distinct(F.split("token", " "))))
    hits = words.join(names, "first_name")
    swapped = F.array_join(
        F.transform(F.split("token", " "), lambda w: F.when(w == F.col("first_name"), F.col("alias")).otherwise(w)), " "
    )
    return hits.select(swapped.alias("token"), "rid", F.lit("alias").alias("meta"))


def domain_variant_pairs(pairs: DataFrame, domains: DataFrame) -> DataFrame:
    """An e-mail on a listed domain gains the same address on every other listed domain."""
    listed = domains.select("domain").distinct()
    others = listed.agg(F.collect_set("domain").alias("_all")).select("_all").scalar()
    mails = pairs.where(F.contains("token", F.lit("@"))).withColumn("domain", F.substring_index("token", "@", -1))
    hits = mails.join(listed, "domain").withColumn("_other", F.explode(F.array_except(others, F.array("domain"))))
    return hits.select(
        F.concat_ws("@", F.substring_index("token", "@", 1), "_other").alias("token"), "rid", F.lit("domain").alias("meta")
    )


def identity_enrichment(pairs: DataFrame, manual: DataFrame, names: DataFrame, domains: DataFrame) -> DataFrame:
    """Real pairs (meta '') plus synthetic ones from manual bridges, name aliases and domain variants."""
    lowered = pairs.select(F.lower("token").alias("token"), "rid")
    out = lowered.withColumn("meta", F.lit(""))
    for part in (
        manual_bridges(lowered, manual),
        name_alias_pairs(lowered, names),
        domain_variant_pairs(lowered, domains),
    ):
        out = out.unionByName(part)
    return out.distinct()


def augmented_groups(pairs: DataFrame, max_iter: int | None = None) -> DataFrame:
    """Synthetic pairs that bridged distinct natural groups.

    A synthetic token is kept when the accounts using it (really or
    synthetically) lie in more than one group of the natural resolution.
    """
    natural = identity_components(pairs.where(F.col("meta") == ""), max_iter, rank=False).select(
        "rid", F.col("group_id").alias("natural_group")
    )
    placed = pairs.join(natural, "rid", "left").withColumn("natural_group", F.coalesce("natural_group", "rid"))
    spread = placed.groupBy("token").agg(
        F.min("natural_group").alias("_a"), F.max("natural_group").alias("_b")
    )
    bridging = spread.where(F.col("_a") != F.col("_b")).select("token")
    return pairs.where(F.col("meta") != "").join(bridging, "token", "left_semi")


def final_groups(references: DataFrame, groups: DataFrame) -> DataFrame:
    """Real account rows with their group; synthetic rows are gone."""
    return references.select("source", "source_account_id", "rid").distinct().join(
        groups.select("rid", "profile_group_id"), "rid"
    )


def profile_link(accounts: DataFrame, sources: Sequence[str]) -> DataFrame:
    """One row per group with one id column per source (the smallest id when a source has several)."""
    return accounts.groupBy("profile_group_id").agg(
        *[F.min(F.when(F.col("source") == s, F.col("source_account_id"))).alias(f"{s}_id") for s in sources]
    )


def profile_emails(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Every known e-mail token beside its group."""
    mails = pairs.where(F.contains("token", F.lit("@"))).select(F.lower("token").alias("email"), "rid")
    return mails.join(groups.select("rid", "profile_group_id"), "rid").select("email", "profile_group_id").distinct()


def lastname_review_list(names: DataFrame, emails: DataFrame, common: Sequence[str], min_score: float) -> DataFrame:
    """Last names against the words of e-mail local parts, across different groups, for manual review.

    ``names``: (last_name, group_id); ``emails``: (email, group_id). A name of n letters reaches
    ``min_score`` only if its first ceil(min_score * n) letters occur together in the word, so an
    equi-join on these finds every pair. From each letter of a word only stretches of lengths that some
    name needs are looked up, so a word gives at most its letters times those lengths. ``min_score``
    must be above 0, where no letter is needed.
    """
    if min_score <= 0:
        raise ValueError("min_score must be above 0")
    name = F.lower("last_name")
    # The small amount keeps 0.6 * 5 at 3 in spite of binary noise.
    needed = F.ceil(F.length("last_name") * F.lit(float(min_score)) - 1e-9).cast("int")
    terms = (
        names.select(name.alias("last_name"), F.col("group_id").alias("name_group"))
        .where(~F.col("last_name").isin(list(common)) & (F.col("last_name") != ""))
        .withColumn("gram", F.substring(F.col("last_name"), F.lit(1), needed))
        .distinct()
    )
    local = F.lower(F.substring_index("email", "@", 1))
    words = emails.select(
        "email", F.col("group_id").alias("email_group"), F.explode(F.array_distinct(F.split(local, "[^a-z]+"))).alias("word")
    ).where(F.col("word") != "")
    # As many lengths as the longest name has letters, at most.
    lengths = terms.agg(F.collect_set(F.length("gram"))).scalar()
    distinct_words = words.select("word").distinct().withColumn("_length", F.explode(lengths)).where(F.col("_length") <= F.length("word"))
    starts = F.sequence(F.lit(1), F.length("word") - F.col("_length") + 1)
    grams = F.transform(starts, lambda i: F.substring(F.col("word"), i, F.col("_length")))
    # Distinct names meet distinct words; only pairs that reach the score are spread to groups and mails.
    by_gram = distinct_words.withColumn("gram", F.explode(F.array_distinct(grams)))
    close = (
        by_gram.join(terms.select("last_name", "gram").distinct(), "gram")
        .select("last_name", "word", lastname_score(F.col("last_name"), F.col("word")).alias("score"))
        .where(F.col("score") >= min_score)
    )
    hits = close.join(terms.drop("gram"), "last_name").join(words, "word").where(F.col("name_group") != F.col("email_group"))
    return hits.groupBy("last_name", "name_group", "email", "email_group").agg(
        F.max_by("word", F.struct("score", "word")).alias("best_word"), F.max("score").alias("score")
    )
