"""Worked examples of identity: reporting lines, grouping, matching, merge and split."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from orgpulse.functions.similarity import _jaro_winkler
from orgpulse.operators import components, history, identity, matching

STAFF = "tenant_id string, id string, unique_key string, status string, workEmail string, supervisorEmail string, stamp int"


def staff(spark, people):
    """(id, email, supervisor, status, stamp) as directory rows."""
    df = spark.createDataFrame([("t", i, f"k{i}", status, mail, boss, stamp) for i, mail, boss, status, stamp in people], STAFF)
    blank = {c: F.lit(None).cast("string") for c in ("displayName", "firstName", "lastName", "department", "division", "jobTitle", "supervisor")}
    return df.withColumns(blank).withColumn("_airbyte_extracted_at", F.timestamp_seconds("stamp")).withColumn("displayName", F.concat(F.col("id"), F.lit("-"), F.col("stamp")))


def test_reporting_line(spark, rows):
    store = identity.person_store(
        staff(spark, [("1", "Cara@x.test", "Ben@x.test", "Active", 1), ("2", "Ben@x.test", "ann@x.test", "Active", 1), ("3", "Ann@x.test", None, "Active", 1), ("4", "Dan@x.test", "Ben@x.test", "Active", 1)])
    )
    got = rows(identity.subordinates(store), "root_id", "person_id", "depth")
    assert got == sorted(
        [("ann@x.test", "ben@x.test", 1), ("ann@x.test", "cara@x.test", 2), ("ann@x.test", "dan@x.test", 2), ("ben@x.test", "cara@x.test", 1), ("ben@x.test", "dan@x.test", 1)], key=repr
    )
    tree = {r.person_id: r.direct_reports for r in identity.people_tree(store, "ANN@x.test").collect()}
    assert tree == {"ann@x.test": ["ben@x.test"], "ben@x.test": ["cara@x.test", "dan@x.test"], "cara@x.test": [], "dan@x.test": []}


def test_cycle_shows_each_person_once(spark, rows):
    store = identity.person_store(staff(spark, [("1", "a@x.test", "b@x.test", "Active", 1), ("2", "b@x.test", "a@x.test", "Active", 1)]))
    assert rows(identity.subordinates(store), "root_id", "person_id") == [("a@x.test", "b@x.test"), ("b@x.test", "a@x.test")]


def test_store_keeps_newest_row_and_drops_blank_mail(spark, rows):
    store = identity.person_store(staff(spark, [("1", "a@x.test", None, "Active", 1), ("1", "a@x.test", None, "Active", 9), ("2", "", None, "Active", 1), ("3", "c@x.test", None, "Inactive", 1)]))
    assert rows(store, "id", "display_name") == [("1", "1-9")]
    assert identity.person_lookup(store, "A@X.TEST").count() == 1


PAIRS = [
    ("marek horak", 1), ("marek.horak@corp.test", 1),
    ("mh77", 2), ("mh77@mail.test", 2),
    ("mh77", 3), ("mh77@other.test", 3),
    ("mh77", 4), ("m.horak@mail.test", 4),
    ("marec horak", 5), ("m.horak@work.test", 5),
]


def enriched(spark):
    pairs = spark.createDataFrame(PAIRS, "token string, rid bigint")
    manual = spark.createDataFrame([], "token_a string, token_b string")
    names = spark.createDataFrame([("marek", "marec"), ("marec", "marek")], "first_name string, alias string")
    domains = spark.createDataFrame([("mail.test",), ("corp.test",), ("work.test",)], "domain string")
    return pairs, components.identity_enrichment(pairs, manual, names, domains)


def test_grouping_before_and_after_enrichment(spark, rows):
    pairs, full = enriched(spark)
    natural = dict(rows(components.identity_components(pairs), "rid", "profile_group_id"))
    assert natural == {1: 1, 2: 2, 3: 2, 4: 2, 5: 3}
    joined = dict(rows(components.identity_components(full), "rid", "profile_group_id"))
    assert joined == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1}


def test_only_bridging_synthetic_pairs_stay(spark, rows):
    _, full = enriched(spark)
    kept = {token for token, _ in rows(components.augmented_groups(full), "token", "rid")}
    # A synthetic token bridges when accounts of several natural groups share it.
    assert kept == {"marec horak", "marek horak", "m.horak@corp.test", "m.horak@mail.test", "m.horak@work.test"}


def brute_groups(pairs):
    parent = {r: r for _, r in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, group in itertools.groupby(sorted(pairs), key=lambda p: p[0]):
        members = [r for _, r in group]
        for m in members[1:]:
            a, b = find(members[0]), find(m)
            parent[max(a, b)] = min(a, b)
    return {r: find(r) for r in parent}


def test_long_chain_and_hot_token_match_brute_force(spark, rows):
    chain = [(f"c{i // 2 if side else (i + 1) // 2}", i + 1) for i in range(200) for side in (0, 1)]
    hot = [("everyone", 1000 + i) for i in range(300)]
    lone = [(f"only{i}", 5000 + i) for i in range(20)]
    pairs = chain + hot + lone
    got = dict(rows(components.identity_components(spark.createDataFrame(pairs, "token string, rid bigint")), "rid", "group_id"))
    assert got == brute_groups(pairs)


def test_too_few_rounds_is_an_error_not_a_wrong_answer(spark):
    chain = [(f"c{(i + s) // 1}", i) for i in range(400) for s in (0, 1)]
    with pytest.raises(RuntimeError):
        components.identity_components(spark.createDataFrame(chain, "token string, rid bigint"), max_iter=2)


def test_generic_tokens_do_not_link(spark, rows):
    pairs = spark.createDataFrame([("admin", 1), ("bob", 2), ("Root", 3), ("valid.name", 4)], "token string, rid bigint")
    assert rows(components.usable_tokens(pairs), "token") == [("valid.name",)]


def test_mail_normal_form_and_domain_variants(spark, rows):
    df = spark.createDataFrame([("email", " Jane.Roe+news@Example.COM "), ("username", " JRoe "), ("employee_id", " E7 ")], "alias_type string, alias_value string")
    domains = spark.createDataFrame([("example.com", "example.dev")], "domain string, equivalent string")
    got = rows(identity.normalize_alias(df, domains), "alias_type", "normal_value", "via")
    assert got == [("email", "jane.roe@example.com", "direct"), ("email", "jane.roe@example.dev", "domain_alias"), ("employee_id", "E7", "direct"), ("username", "jroe", "direct")]


OBS = "tenant_id string, source_type string, source_account_id string, alias_type string, alias_value string"


def test_alias_walk_through(spark, rows):
    seen = [
        ("t", "hr", "E9", "employee_id", "E9"), ("t", "hr", "E9", "email", "nora.lind@firm.test"), ("t", "ad", "nlind", "username", "nlind"),
        ("t", "ad", "nlind", "email", "nora.berg@firm.test"), ("t", "git", "42", "username", "noral"), ("t", "gitlab", "17", "username", "lind.nora"), ("t", "jira", "nl", "username", "NLind"),
    ]
    obs = spark.createDataFrame(seen, OBS).withColumns({"operation_type": F.lit("UPSERT"), "_synced_at": F.lit("2024-01-01").cast("timestamp")})
    known = [("t", "P1", "hr", "E9", "employee_id", "E9"), ("t", "P1", "hr", "E9", "email", "nora.lind@firm.test"), ("t", "P1", "wiki", "w1", "username", "nlind")]
    aliases = spark.createDataFrame(known, "tenant_id string, person_id string, source_type string, source_account_id string, alias_type string, alias_value string")
    out = matching.bootstrap_job(obs, aliases, None)
    assert {r.alias_value for r in out.aliases.collect()} == {"E9", "nora.lind@firm.test", "nlind"}
    waiting = {r.alias_value: (r.suggested_person_id, r.suggestion_confidence) for r in out.unmapped.collect()}
    assert waiting == {"nora.berg@firm.test": (None, None), "noral": (None, None), "lind.nora": (None, None)}
    assert out.conflicts.count() == 0


def test_unmapped_queue_counts_and_resolves(spark, rows):
    obs = spark.createDataFrame([("t", "git", "1", "username", "zed99")] * 3, OBS).withColumns({"operation_type": F.lit("UPSERT"), "_synced_at": F.lit("2024-01-01").cast("timestamp")})
    aliases = spark.createDataFrame([("t", "P1", "hr", "1", "email", "old@x.test")], "tenant_id string, person_id string, source_type string, source_account_id string, alias_type string, alias_value string")
    stored = spark.createDataFrame([("t", "git", "username", "zed99", 4, "pending"), ("t", "hr", "email", "old@x.test", 1, "pending")], "tenant_id string, source_type string, alias_type string, alias_value string, occurrences bigint, status string")
    out = matching.bootstrap_job(obs, aliases, stored).unmapped
    assert rows(out, "alias_value", "occurrences", "status") == [("old@x.test", 1, "resolved"), ("zed99", 7, "pending")]


def test_fuzzy_rules_never_link(spark, rows):
    value = ("t", "git", "display_name", "Jon Smith")
    frame = spark.createDataFrame([(*value, "P1", "name_jaro_winkler", 1.0), (*value, "P1", "name_soundex", 1.0)], "tenant_id string, source_type string, alias_type string, alias_value string, person_id string, rule string, confidence double")
    assert rows(matching.composite_confidence(frame), "decision") == [("suggest",)]


def test_merge_then_split_restores_and_never_twice(spark, rows):
    aliases = spark.createDataFrame([("a1", "P1"), ("a2", "P1"), ("a3", "P2")], "alias_id string, person_id string")
    merged, audit = identity.merge_persons(aliases, "P1", "P2", "m1", "2024-01-01")
    assert rows(merged) == [("a1", "P2"), ("a2", "P2"), ("a3", "P2")]
    restored, marked = identity.split_persons(merged, audit, "m1")
    assert rows(restored) == rows(aliases)
    again, _ = identity.split_persons(merged, marked, "m1")
    assert rows(again) == rows(merged)


def test_completeness_is_a_share_of_seven(spark):
    seen = [("t", "P", a, v, "hr", 1) for a, v in (("display_name", "N"), ("email", "n@x.test"), ("role", "dev"), ("location", ""))]
    obs = spark.createDataFrame(seen, "tenant_id string, person_id string, attribute string, value string, source_kind string, s int").withColumn("observed_at", F.timestamp_seconds("s"))
    assert identity.golden_record(obs).first().completeness_score == pytest.approx(3 / 7)


def test_snapshot_is_idempotent(spark):
    src = spark.createDataFrame([("k1", "a", None), ("k2", "b", "x")], "unique_key string, name string, role string")
    at = F.lit("2024-01-01").cast("timestamp")
    first = history.snapshot_scd2(src, None, "unique_key", ["name", "role"], at)
    assert first.count() == 2
    assert history.snapshot_scd2(src, first, "unique_key", ["name", "role"], at).count() == 0
    blank = src.withColumn("role", F.coalesce("role", F.lit("")))
    assert history.snapshot_scd2(blank, first, "unique_key", ["name", "role"], at).count() == 1


def test_deactivation_deletes_every_identity_field(spark, rows):
    log = spark.createDataFrame([("t", "s", "7", "status", "", "Terminated"), ("t", "s", "7", "workEmail", "", "a@x.test")], "tenant_id string, source_id string, entity_id string, field_name string, old_value string, new_value string")
    out = history.bootstrap_inputs_from_history(log.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp")), "bamboohr", history.TRACKED["hr_employees"])
    assert rows(out, "operation_type", "alias_type", "alias_value") == [("DELETE", "display_name", ""), ("DELETE", "email", ""), ("DELETE", "employee_id", ""), ("UPSERT", "email", "a@x.test")]


def test_review_list_finds_short_names_and_one_letter_starts(spark, rows):
    names = spark.createDataFrame([("li", 1), ("smith", 2)], "last_name string, group_id int")
    mails = spark.createDataFrame([("li@x.test", 3), ("smyth@x.test", 4), (None, 5)], "email string, group_id int")
    got = rows(components.lastname_review_list(names, mails, [], 0.1), "last_name", "email")
    assert got == [("li", "li@x.test"), ("smith", "smyth@x.test")]
    with pytest.raises(ValueError):
        components.lastname_review_list(names, mails, [], 0.0)


def test_similar_names_match_all_pairs(spark, rows):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 18))).strip() for _ in range(120)]
    others = base[:40] + ["Marta Nowosielec".lower()]
    for name in base:
        spot = rng.randrange(len(name) + 1)
        others.append(rng.choice([name[:spot] + "z" + name[spot:], name[:spot] + name[spot + 1 :], name[:spot] + name[spot + 1 : spot + 2] + name[spot : spot + 1] + name[spot + 2 :]]))
    base.append("marka nowosielec")
    frame = lambda names: spark.createDataFrame([("t", n) for n in names], "tenant_id string, name string")
    got = rows(matching.similar_names(frame(base), frame(others)), "name", "other")
    want = sorted({(a, b) for a in base for b in others if a and b and _jaro_winkler(a, b) >= matching.NAME_SIMILARITY}, key=repr)
    assert got == want and ("marka nowosielec", "marta nowosielec") in got


def test_few_names_are_compared_that_are_not_similar(spark, rows, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(14)) for _ in range(400)]
    others = [n[: i % 14] + "x" + n[i % 14 + 1 :] for i, n in enumerate(base)]
    frame = lambda names: spark.createDataFrame([("t", n) for n in names], "tenant_id string, name string")
    monkeypatch.setattr(matching, "NAME_SIMILARITY", 0.0)
    compared = rows(matching.similar_names(frame(base), frame(others)), "name", "other")
    assert set(zip(base, others)) <= set(compared) and len(compared) < 2 * len(base)


def test_long_similar_names_match_all_pairs(spark, rows):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(15, 60))) for _ in range(60)] + ["ab" * 50, "abc" * 30]
    others = [n[:-k] if k else n for n in base for k in (0, 1, len(n) // 6, len(n) // 4)] + [n[:9] + n[10:11] + n[9:10] + n[11:] + "xy" for n in base]
    frame = lambda names: spark.createDataFrame([("t", n) for n in names], "tenant_id string, name string")
    got = rows(matching.similar_names(frame(base), frame(others)), "name", "other")
    want = sorted({(a, b) for a in base for b in others if _jaro_winkler(a, b) >= matching.NAME_SIMILARITY}, key=repr)
    assert got == want and len(want) > 2 * len(base)


def _sounding(rng, n):
    """Names of one sound: consonants of r, b and t between vowels."""
    return ["".join(x + "".join(rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for x in ("r", "b", "t")) for _ in range(n)]


def _dealt(df):
    """Rows that the plan of a frame, once collected, has written to shuffles."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        metric = node.metrics().get("shuffleRecordsWritten")
        inner = node.children()
        return (metric.get().value() if metric.isDefined() else 0) + sum(walk(inner.apply(i)) for i in range(inner.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_pairs_of_one_sound_are_not_dealt(spark, rows):
    rng = random.Random(11)
    base, others = sorted(set(_sounding(rng, 400))), sorted(set(_sounding(rng, 400)))
    frame = lambda names, who: spark.createDataFrame([("t", "git", "display_name", n, f"P{i}") for i, n in enumerate(names)], "tenant_id string, source_type string, alias_type string, alias_value string, person_id string").drop(*who)
    found = matching.match_candidates(frame(base, ["person_id"]), frame(others, []), fuzzy=True)
    pairs = found.collect()
    assert len({(r.alias_value, r.person_id) for r in pairs}) == len(pairs) == len(base) * len(others)
    assert _dealt(found) < len(pairs) / 10


def test_name_rules_match_all_pairs(spark, rows, monkeypatch):
    # Cells of a few rows, persons of several names and of none, values of several sources and cases.
    monkeypatch.setattr(matching, "CELL_SIDE", 3)
    rng = random.Random(12)
    names = sorted(set(_sounding(rng, 25))) + ["Marta Nowak", "marta nowak ", "Martha Nowack", "mike", " ", "", None, "42"]
    values = sorted({(rng.choice("tu"), rng.choice(["git", "hr", None]), rng.choice([n, n and n.upper()])) for n in names * 4}, key=repr)
    known = [(rng.choice("tu"), rng.choice([None, "P1", "P2", *(f"Q{i}" for i in range(20))]), n) for n in names * 4]
    seen = spark.createDataFrame([(t, s, "display_name", v) for t, s, v in values * 2], "tenant_id string, source_type string, alias_type string, alias_value string")
    aliases = spark.createDataFrame([(t, p, "hr", "display_name", n) for t, p, n in known], "tenant_id string, person_id string, source_type string, alias_type string, alias_value string")
    sounds = {r[0]: r[1] for r in spark.createDataFrame([(n.strip().lower(),) for n in names if n], "n string").select("n", F.soundex("n")).collect()}
    folded = lambda n: (n or "").strip().lower()
    want = {}
    for (t, s, v), (u, p, n) in itertools.product(values, known):
        if t == u and folded(v) and folded(n):
            near = _jaro_winkler(folded(v), folded(n)) >= matching.NAME_SIMILARITY
            if near or sounds[folded(v)] == sounds[folded(n)]:
                rule = ("name_jaro_winkler", 0.75) if near else ("name_soundex", 0.6)
                want[t, s, v, p] = max(want.get((t, s, v, p), rule), rule, key=lambda x: x[1])
    got = rows(matching.match_candidates(seen, aliases, fuzzy=True), "tenant_id", "source_type", "alias_value", "person_id", "rule", "confidence")
    assert got == sorted(((*k, *r) for k, r in want.items()), key=repr)
    assert {r for r, _ in want.values()} == set(matching.FUZZY) and any(k[3] is None for k in want)


def test_two_supervisors_give_one_row(spark, rows):
    lines = [("t", "top", None), ("t", "b", "top"), ("t", "c", "top"), ("t", "d", "b"), ("t", "d", "c"), ("t", "d", "top"), ("t", "e", "d")]
    store = spark.createDataFrame(lines, "tenant_id string, person_id string, supervisor_id string")
    got = rows(identity.subordinates(store, "top"), "person_id", "depth")
    assert got == [("b", 1), ("c", 1), ("d", 1), ("e", 2)]


def test_merging_batches_equals_one_run(spark):
    import random

    rng = random.Random(6)
    pairs = [(f"t{rng.randrange(60)}", rng.randrange(80)) for _ in range(110)] + [("lone", 500), ("t1", 7), ("t1", 7)]
    want = {r.rid: r.group_id for r in components.identity_components(spark.createDataFrame(pairs, "token string, rid bigint"), rank=False).collect()}
    accounts, tokens, given = {}, {}, []
    for at in range(0, len(pairs), 23):
        batch = spark.createDataFrame(pairs[at : at + 23], "token string, rid bigint")
        stored = spark.createDataFrame(list(accounts.items()), "rid bigint, group_id bigint"), spark.createDataFrame(list(tokens.items()), "token string, group_id bigint")
        changed, changed_tokens = ([tuple(r) for r in df.collect()] for df in components.merge_batch(*stored, batch))
        assert len({k for k, _ in changed}) == len(changed) and len({k for k, _ in changed_tokens}) == len(changed_tokens)
        given.append(len(changed))
        accounts.update(changed)
        tokens.update(changed_tokens)
    assert accounts == want and tokens == {t: want[r] for t, r in pairs}
    repeated = spark.createDataFrame(pairs[:20], "token string, rid bigint")
    stored = spark.createDataFrame(list(accounts.items()), "rid bigint, group_id bigint"), spark.createDataFrame(list(tokens.items()), "token string, group_id bigint")
    assert [df.count() for df in components.merge_batch(*stored, repeated)] == [0, 0]


def test_a_very_long_word_gives_few_keys(spark, rows):
    names = spark.createDataFrame([("Meier", 1), ("Ng", 2)], "last_name string, group_id int")
    mails = spark.createDataFrame([("x" * 3000 + "meie" + "y" * 3000 + "@x.com", 3), ("ng@x.com", 2)], "email string, group_id int")
    got = rows(components.lastname_review_list(names, mails, [], 0.3), "last_name", "email_group")
    assert got == [("meier", 3)]


def test_a_batch_looks_stored_groups_up_once(spark, rows):
    stored = spark.createDataFrame([(1, 1), (2, 1), (9, 9)], "rid bigint, group_id bigint"), spark.createDataFrame([("t", 1), ("u", 9)], "token string, group_id bigint")
    changed, changed_tokens = components.merge_batch(*stored, spark.createDataFrame([("t", 9), ("v", 2), ("v", 5)], "token string, rid bigint"))
    joins = [df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for df in (changed, changed_tokens)]
    # Of each, one with what moved and one for members of merged groups; tokens also leave out the stored ones.
    assert joins == [2, 3]
    assert (rows(changed), rows(changed_tokens)) == ([(5, 1), (9, 1)], [("u", 1), ("v", 1)])
