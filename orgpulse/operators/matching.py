"""Candidate matching of alias observations to persons, and the batch that applies it.

Every rule is an equality on a derived key, so the rules on mails, ids and
usernames share one equi-join on (tenant, rule family, key). Observations are
folded to distinct values and aliases to distinct persons before it, so copies of
one value cost one row. Names of one sound can be very many: their pairs come
straight from a join that gives each once, and aren't dealt again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx
from orgpulse.functions.similarity import jaro_winkler
from orgpulse.operators.identity import strip_plus_tag
from orgpulse.session import cut_lineage

# Rule confidences, thresholds, and the similarity a name must reach.
CONFIDENCE = {
    "email_exact": 1.0,
    "hr_id_match": 1.0,
    "username_same_sys": 0.95,
    "email_case_norm": 0.95,
    "email_plus_tag": 0.93,
    "email_domain_alias": 0.92,
    "username_cross_sys": 0.85,
    "email_to_username": 0.72,
    "name_jaro_winkler": 0.75,
    "name_soundex": 0.60,
}
FUZZY = ["name_jaro_winkler", "name_soundex"]
LINK_AT, SUGGEST_AT = 1.0, 0.5
NAME_SIMILARITY = 0.95
# Values, and persons, of one sound that meet in one cell of a join; it sets no limit on pairs.
CELL_SIDE = 1000

VALUE = ["tenant_id", "source_type", "alias_type", "alias_value"]


@dataclass(frozen=True)
class Keys:
    """Derived forms of one alias value."""

    trimmed: Column
    folded: Column
    untagged: Column
    local: Column


def _forms(prefix: str) -> Keys:
    trimmed = F.trim(f"{prefix}alias_value")
    folded = F.lower(trimmed)
    untagged = strip_plus_tag(folded)
    return Keys(trimmed, folded, untagged, F.substring_index(untagged, "@", 1))


def _with_domain(df: DataFrame, domain_groups: DataFrame | None) -> DataFrame:
    """Add the representative of the e-mail's domain: its group when listed, else the domain itself."""
    own = F.substring_index(strip_plus_tag(F.lower(F.trim("alias_value"))), "@", -1)
    rows = df.withColumn("_domain", F.when(F.col("alias_type") == "email", own))
    if domain_groups is None:
        return rows.withColumn("_home", F.col("_domain"))
    groups = domain_groups.select(F.col("domain").alias("_domain"), F.col("domain_group").alias("_group"))
    return rows.join(groups, "_domain", "left").withColumn("_home", F.coalesce("_group", "_domain")).drop("_group")


def _keyed(df: DataFrame, side: str) -> DataFrame:
    """One row per (rule family, key) a value takes part in."""
    k = _forms("")
    kind = F.col("alias_type")
    mail, user = kind == "email", kind == "username"

    def entry(family: str, key: Column, cond: Column) -> Column:
        return F.when(cond, F.struct(F.lit(family).alias("family"), key.alias("key")))

    entries = [
        entry("email", F.concat_ws("@", k.local, F.col("_home")), mail),
        entry("employee_id", F.concat_ws("|", F.col("source_type"), k.trimmed), kind == "employee_id"),
        entry("username", k.folded, user),
        # The local part of an e-mail on one side meets a username on the other.
        entry("mail_user" if side == "left" else "user_mail", k.local, mail),
        entry("user_mail" if side == "left" else "mail_user", k.folded, user),
    ]
    found = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return df.withColumn("_e", F.explode(found)).select("*", "_e.family", "_e.key").drop("_e")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, not for each element of a lambda in it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbered_letters(name: Column) -> Column:
    """Letters of a name as a set: the second e is another member than the first."""

    def number(letter: Column, i: Column) -> Column:
        start = F.substring(name, F.lit(1), i + 1)
        times = F.length(start) - F.length(F.replace(start, letter, F.lit("")))
        return F.concat(F.lpad(times.cast("string"), 6, "0"), letter)

    return F.transform(F.split(name, ""), number)


def _measured(numbered: Column) -> Column:
    """What a numbered letter is counted as: the ninth e and those after it as the eighth, so that counts are bounded by the alphabet."""
    return F.concat(F.least(F.substring(numbered, 1, 6), F.lit("000008")), F.substring(numbered, 7, 2))


def letter_counts(names: DataFrame, name: str) -> Column:
    """Map of each letter to the number of names that have it (of repeated letters, that many times)."""
    letters = names.select(F.explode(F.array_distinct(F.transform(_numbered_letters(F.col(name)), _measured))).alias("letter"))
    counted = letters.groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.map_from_entries(F.collect_list(F.struct("letter", "n")))).scalar()


def seldom_letters(name: Column, counts: Column) -> Column:
    """The numbered letters of a name, seldom ones (by ``counts``) first."""
    rated = F.transform(_numbered_letters(name), lambda c: F.struct(F.coalesce(F.try_element_at(counts, _measured(c)), F.lit(0)).alias("n"), c.alias("c")))
    return F.transform(F.sort_array(rated), lambda r: r["c"])


def _span(length: Column) -> Column:
    """Lengths that are treated as one: each for itself below 20, from there on 5 to 10 in a hundred apart."""
    return F.when(length < 20, 1).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(length / 10)))).cast("int")


def _shortest(length: Column) -> Column:
    """Shortest length that is treated as ``length``."""
    return length - length % _span(length)


def _shared(a: Column, b: Column) -> Column:
    """Letters that names of two lengths share at ``NAME_SIMILARITY`` or above.

    With a common start of at most four letters such names have a Jaro similarity of 11/12 or more. Of its three
    parts the last is at most 1, so the shares of matched letters m/a + m/b come to 7/4 or more.
    """
    return F.ceil(F.lit(7.0) * a * b / (4 * (a + b)) - 1e-9).cast("int")


def _least(other: Column, length: Column) -> Column:
    """``other``, or the shortest length that a name of ``length`` can be so near to."""
    return F.greatest(other, F.ceil(length * 3 / 4).cast("int"))


def _kept_and_left(length: Column, other: Column) -> tuple[Column, Column]:
    """Letters in a key of a name that meets those of a length treated as ``other``, and letters it can do without."""
    own = _shortest(length)
    # The same on both sides: least letters shared and most letters left out, of all lengths treated alike.
    least = _shared(_least(own, other), _least(other, own))
    most = F.greatest(own + _span(own), other + _span(other)) - 1 - least
    k = F.least(least, F.when(most <= 0, least).when(most == 1, 35).when(most == 2, 7).when(most == 3, 4).otherwise(3))
    return k, length - _shared(length, _least(other, length))


def _all_letters(length: Column, other: Column) -> Column:
    """Whether keys are of any letters of the name, so that no order of these matters."""
    k, left_out = _kept_and_left(length, other)
    return left_out + k >= length


def shared_letter_keys(letters: Column, length: Column, other: Column) -> Column:
    """Keys of which a name and one of a length treated as ``other`` always have one in common, if they are near enough.

    Of n letters (``letters``, seldom ones first in one order for all names) at least m are shared, so the first
    k shared ones lie among the first n - m + k on both sides. A key is k of these. Of two names of 14 letters
    13 are shared, so keys are the name without one of its letters; where fewer are shared, k is less, so that
    a name has few keys. A key is the XOR of its letters' hashes, whatever their order.
    """
    k, left_out = _kept_and_left(length, other)

    def all_but_one(first: Column) -> Column:
        whole = F.aggregate(first, F.lit(0).cast("long"), lambda key, letter: key.bitwiseXOR(letter))
        return _bound(whole, lambda w: F.when(left_out <= 0, F.array(w)).otherwise(F.transform(first, lambda letter: w.bitwiseXOR(letter))))

    def add(found: Column, letter: Column) -> Column:
        taken = F.transform(
            F.filter(found, lambda f: f["take"] > 0),
            lambda f: F.struct(f["key"].bitwiseXOR(letter).alias("key"), (f["take"] - 1).alias("take"), f["leave"].alias("leave")),
        )
        left = F.transform(
            F.filter(found, lambda f: f["leave"] > 0),
            lambda f: F.struct(f["key"].alias("key"), f["take"].alias("take"), (f["leave"] - 1).alias("leave")),
        )
        return F.concat(taken, left)

    def chosen(first: Column) -> Column:
        start = F.array(F.struct(F.lit(0).cast("long").alias("key"), k.alias("take"), left_out.alias("leave")))
        return F.transform(F.aggregate(first, start, add), lambda f: f["key"])

    hashed = F.transform(F.slice(letters, F.lit(1), left_out + k), lambda letter: F.xxhash64(letter))
    return _bound(hashed, lambda first: F.when(left_out <= 1, all_but_one(first)).otherwise(chosen(first)))


def similar_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(tenant_id, name, other, similarity): pairs of distinct (tenant_id, name) at ``NAME_SIMILARITY`` or above.

    Names meet on nearly all of their letters, seldom ones first by how many names have each, and only if
    their lengths allow the similarity.
    """
    # One row per name holds the counts that its letters are ordered by.
    counts = letter_counts(left.select("name").union(right.select("name")).distinct(), "name")
    # Keys are many times the names, so names are dealt to all cores first, however few bytes they have.
    cores = left.sparkSession.sparkContext.defaultParallelism

    def lengths(df: DataFrame) -> DataFrame:
        return df.where(F.col("name") != "").select("tenant_id", _shortest(F.length("name")).alias("_length")).distinct()

    def keyed(df: DataFrame, others: DataFrame, out: str, sides: list[str]) -> DataFrame:
        names = df.select("tenant_id", F.col("name").alias(out)).where(F.col(out) != "").distinct()
        n, other = F.length(out), F.col("_length")
        met = names.join(others, "tenant_id").where((other * 3 <= n * 4) & ((other + _span(other) - 1) * 4 >= n * 3))
        rated = met.repartition(cores, "tenant_id", out).withColumn("_counts", F.when(~_all_letters(n, other), counts))
        letters = F.when(F.col("_counts").isNull(), _numbered_letters(F.col(out))).otherwise(seldom_letters(F.col(out), F.col("_counts")))
        keys = rated.select("tenant_id", out, _shortest(n).alias(sides[0]), other.alias(sides[1]), F.explode(shared_letter_keys(letters, n, other)).alias("_letters"))
        # A hash is short to deal; what it brings together by chance isn't similar and goes below.
        return keys.select("tenant_id", out, F.xxhash64("_left", "_right", "_letters").alias("_key"))

    # Three quarters of the longer name's letters are matched, so the shorter one has as many.
    near = (F.length("name") * 4 >= F.length("other") * 3) & (F.length("other") * 4 >= F.length("name") * 3)
    met = keyed(left, lengths(right), "name", ["_left", "_right"]).join(keyed(right, lengths(left), "other", ["_right", "_left"]), ["tenant_id", "_key"])
    pairs = met.where(near).select("tenant_id", "name", "other").distinct()
    return pairs.withColumn("similarity", jaro_winkler(F.col("name"), F.col("other"))).where(F.col("similarity") >= NAME_SIMILARITY)


def _cell(side: Column, *cols: str) -> Column:
    """Number of the cell, of as many as ``side`` rows need, that a row falls into."""
    return F.pmod(F.xxhash64(*cols), F.ceil(side / CELL_SIDE))


def _cells(side: Column) -> Column:
    """Numbers of all cells of ``side`` rows."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(side / CELL_SIDE) - 1))


def same_sound(mine: DataFrame, theirs: DataFrame, nearby: DataFrame) -> DataFrame:
    """(value, person_id): all pairs of equal ``sound`` but those in ``nearby``, each once.

    * ``mine``: distinct values, name, sound
    * ``theirs``: distinct tenant_id, sound, person_id
    * ``nearby``: distinct tenant_id, name, person_id

    The l values and r persons of a sound meet in cells of ``CELL_SIDE`` to a side, so one sound that many share
    is spread over tasks. A value carries those persons of a cell that it must not be paired with.
    """
    heard = ["tenant_id", "sound"]
    sides = mine.groupBy(*heard).agg(F.count(F.lit(1)).alias("_l")).join(theirs.groupBy(*heard).agg(F.count(F.lit(1)).alias("_r")), heard)
    column = _cell(F.col("_r"), "person_id").alias("_column")
    # A list leaves out null, so a person without id is told by a flag.
    listed = (
        nearby.withColumn("sound", F.soundex("name"))
        .join(sides, heard)
        .groupBy("tenant_id", "name", column)
        .agg(F.collect_list("person_id").alias("_near"), F.max(F.col("person_id").isNull()).alias("_near_null"))
    )
    cell = [*heard, "_row", "_column"]
    # Few bytes give very many pairs, so cells are dealt to all cores, however few bytes they have.
    tasks = 4 * mine.sparkSession.sparkContext.defaultParallelism
    values = mine.join(sides, heard).select(*VALUE, "name", "sound", _cell(F.col("_l"), *VALUE).alias("_row"), _cells(F.col("_r")).alias("_column"))
    values = values.join(listed, ["tenant_id", "name", "_column"], "left").select(*VALUE, *cell[1:], "_near", "_near_null").repartition(tasks, *cell)
    persons = theirs.join(sides, heard).select(*heard, "person_id", column, _cells(F.col("_l")).alias("_row")).repartition(tasks, *cell)
    near = F.coalesce(F.array_contains("_near", F.col("person_id")), F.col("_near_null"), F.lit(False))
    return values.join(persons, cell).where(~near).select(*VALUE, "person_id")


def _name_rules(left: DataFrame, right: DataFrame) -> DataFrame:
    """Display names that are similar, by whatever letters differ, or sound alike; where both hold, the stronger rule."""
    shown = (F.col("alias_type") == "display_name") & (F.trim("alias_value") != "")
    mine = left.where(shown).select(*VALUE).distinct().withColumn("name", F.lower(F.trim("alias_value")))
    theirs = right.where(shown).select("tenant_id", "person_id", F.lower(F.trim("alias_value")).alias("other")).distinct()
    near = similar_names(mine, theirs.withColumnRenamed("other", "name"))
    # Both rules read these pairs, few beside the keys they are found by, so names are compared once.
    nearby = cut_lineage(near.join(theirs, ["tenant_id", "other"]).select("tenant_id", "name", "person_id").distinct())
    heard = theirs.select("tenant_id", F.soundex("other").alias("sound"), "person_id").distinct()
    alike = same_sound(mine.withColumn("sound", F.soundex("name")), heard, nearby)

    def rated(pairs: DataFrame, rule: str) -> DataFrame:
        return pairs.select(*VALUE, "person_id", F.lit(rule).alias("rule"), F.lit(CONFIDENCE[rule]).alias("confidence"))

    return rated(mine.join(nearby, ["tenant_id", "name"]), "name_jaro_winkler").unionByName(rated(alike, "name_soundex"))


def match_candidates(
    observations: DataFrame, aliases: DataFrame, domain_groups: DataFrame | None = None, fuzzy: bool = False
) -> DataFrame:
    """(value, person, rule, confidence). Of the nested e-mail and username rules only the strongest one is given."""
    exact = F.col("alias_type").isin("email", "employee_id", "username")
    left = _keyed(_with_domain(observations.where(exact).select(*VALUE).distinct(), domain_groups), "left")
    known = aliases.where(exact).select("tenant_id", "person_id", "source_type", "alias_type", "alias_value").distinct()
    right = _keyed(_with_domain(known, domain_groups), "right").select(
        "tenant_id", "family", "key", "person_id", *[F.col(c).alias(f"p_{c}") for c in ("source_type", "alias_type", "alias_value")]
    )
    pairs = left.join(right, ["tenant_id", "family", "key"])
    mine, theirs = _forms(""), _forms("p_")
    same_system = F.col("source_type") == F.col("p_source_type")
    family = F.col("family")
    rule = fx.multi_if(
        ((family == "email") & (mine.trimmed == theirs.trimmed), F.lit("email_exact")),
        ((family == "email") & (mine.folded == theirs.folded), F.lit("email_case_norm")),
        ((family == "email") & (mine.untagged == theirs.untagged), F.lit("email_plus_tag")),
        (family == "email", F.lit("email_domain_alias")),
        (family == "employee_id", F.lit("hr_id_match")),
        ((family == "username") & same_system, F.lit("username_same_sys")),
        (family == "username", F.lit("username_cross_sys")),
        (family.isin("mail_user", "user_mail") & ~same_system, F.lit("email_to_username")),
        default=F.lit(None),
    )
    decided = pairs.withColumn("rule", rule).select(*VALUE, "person_id", "family", "rule")
    # A rule's number grows with its confidence, so the strongest one is a plain maximum.
    ranked = sorted(CONFIDENCE, key=lambda r: (CONFIDENCE[r], r))
    number = F.create_map(*[x for i, r in enumerate(ranked) for x in (F.lit(r), F.lit(i))])
    group = F.when(family.isin("mail_user", "user_mail"), F.lit("cross")).otherwise(family)
    rated = decided.where(F.col("rule").isNotNull()).withColumn("_group", group)
    best = rated.groupBy(*VALUE, "person_id", "_group").agg(F.max(number[F.col("rule")]).alias("_rule"))
    rules, scores = F.array(*map(F.lit, ranked)), F.array(*[F.lit(CONFIDENCE[r]) for r in ranked])
    found = best.select(*VALUE, "person_id", rules[F.col("_rule")].alias("rule"), scores[F.col("_rule")].alias("confidence"))
    return found.unionByName(_name_rules(observations, aliases)) if fuzzy else found


def composite_confidence(candidates: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Weighted mean of rule scores per (value, person); best person per value; link, suggest or leave unmapped.

    ``weights`` has rows (rule, weight); missing rules weigh 1. Fuzzy rules alone never link.
    """
    rows = candidates
    if weights is not None:
        rows = rows.join(weights, "rule", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    weight = F.coalesce(F.col("weight"), F.lit(1.0))
    scored = rows.groupBy(*VALUE, "person_id").agg(
        fx.ratio(F.sum(weight * F.col("confidence")), F.sum(weight)).alias("confidence"),
        F.max(fx.flag(~F.col("rule").isin(FUZZY))).alias("_firm"),
    )
    best = F.max_by(F.struct("person_id", "confidence", "_firm"), F.struct("confidence", "person_id"))
    top = scored.groupBy(*VALUE).agg(best.alias("_b"), F.count(F.lit(1)).alias("persons_considered"))
    conf = F.col("_b.confidence")
    decision = fx.multi_if(
        ((conf >= LINK_AT) & (F.col("_b._firm") == 1), F.lit("link")),
        (conf >= SUGGEST_AT, F.lit("suggest")),
        default=F.lit("unmapped"),
    )
    return top.select(*VALUE, F.col("_b.person_id").alias("person_id"), conf.alias("confidence"), "persons_considered", decision.alias("decision"))


@dataclass(frozen=True)
class BootstrapResult:
    aliases: DataFrame
    unmapped: DataFrame
    conflicts: DataFrame


def bootstrap_job(
    observations: DataFrame, aliases: DataFrame, unmapped: DataFrame | None, domain_groups: DataFrame | None = None
) -> BootstrapResult:
    """Turn new observations into alias upserts, unmapped-queue upserts and conflicts.

    * ``observations``: tenant_id, source_type, source_account_id, alias_type, alias_value, operation_type, _synced_at
    * ``aliases``: tenant_id, person_id, source_type, source_account_id, alias_type, alias_value
    * ``unmapped``: tenant_id, source_type, alias_type, alias_value, occurrences, status
    """
    kind = F.col("alias_type")
    normal = F.when(kind.isin("email", "username"), F.lower(F.trim("alias_value"))).otherwise(F.trim("alias_value"))
    seen = (
        observations.where((F.col("operation_type") == "UPSERT") & fx.filled("alias_value"))
        .withColumn("alias_value", normal)
        .groupBy("tenant_id", "source_type", "source_account_id", "alias_type", "alias_value")
        .agg(F.count(F.lit(1)).alias("occurrences"), F.max("_synced_at").alias("last_observed_at"))
    )
    value_key = ["tenant_id", "alias_type", "alias_value"]
    owner = aliases.groupBy(*value_key).agg(F.min("person_id").alias("owner_id"))
    account_key = ["tenant_id", "source_type", "source_account_id"]
    account = aliases.groupBy(*account_key).agg(F.min("person_id").alias("account_person_id"))
    looked = seen.join(owner, value_key, "left").join(account, account_key, "left")

    matched = looked.where(F.col("owner_id").isNotNull())
    clash = F.col("account_person_id").isNotNull() & (F.col("account_person_id") != F.col("owner_id"))
    conflicts = matched.where(clash).select(
        *value_key,
        F.col("owner_id").alias("person_id_a"),
        F.col("account_person_id").alias("person_id_b"),
        F.col("source_type").alias("source_type_b"),
        F.lit("open").alias("status"),
    )
    touched = matched.where(~clash).select(
        *value_key, "source_type", "source_account_id", F.col("owner_id").alias("person_id"), F.lit(1.0).alias("confidence"), F.lit("touch").alias("action"), "last_observed_at"
    )

    fresh = looked.where(F.col("owner_id").isNull())
    verdict = composite_confidence(match_candidates(fresh, aliases, domain_groups)).select(
        *VALUE, "person_id", "confidence", "decision"
    )
    judged = fresh.join(verdict, VALUE, "left")
    linked = judged.where(F.col("decision") == "link").select(
        *value_key, "source_type", "source_account_id", "person_id", "confidence", F.lit("link").alias("action"), "last_observed_at"
    )
    waiting = judged.where(F.coalesce(F.col("decision"), F.lit("unmapped")) != "link")
    queue = waiting.groupBy("tenant_id", "source_type", "alias_type", "alias_value").agg(
        F.sum("occurrences").alias("occurrences"),
        F.max(F.when(F.col("decision") == "suggest", F.col("person_id"))).alias("suggested_person_id"),
        F.max(F.when(F.col("decision") == "suggest", F.col("confidence"))).alias("suggestion_confidence"),
        F.lit("pending").alias("status"),
    )
    if unmapped is not None:
        queue = _merge_queue(unmapped, queue, linked.select(*value_key).unionByName(aliases.select(*value_key)).distinct())
    return BootstrapResult(touched.unionByName(linked), queue, conflicts)


def _merge_queue(stored: DataFrame, fresh: DataFrame, mapped: DataFrame) -> DataFrame:
    """Add occurrences to waiting rows; rows whose value now has an alias become resolved."""
    keys = ["tenant_id", "source_type", "alias_type", "alias_value"]
    rows = stored.unionByName(fresh, allowMissingColumns=True).groupBy(*keys).agg(
        F.sum("occurrences").alias("occurrences"),
        F.max("suggested_person_id").alias("suggested_person_id"),
        F.max("suggestion_confidence").alias("suggestion_confidence"),
    )
    done = mapped.withColumn("_done", F.lit(1))
    out = rows.join(done, ["tenant_id", "alias_type", "alias_value"], "left")
    return out.withColumn("status", F.when(F.col("_done") == 1, F.lit("resolved")).otherwise(F.lit("pending"))).drop("_done")
