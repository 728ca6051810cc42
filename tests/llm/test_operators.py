"""The dealt operators against brute force, and on nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
import string
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from orgpulse.llm import bpe, components, fingerprints, ngram_join, pii, poisson_mix, suffix_dedup, toxicity, url_cascade, vector_search, warc

WORDS = "the of and to in that was for on are with his they at be this have from or one had by word but not what all were we when".split()
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def texts(n, seed=1):
    """Random texts with exact copies, near copies, a shared passage and awkward ones."""
    rnd = random.Random(seed)
    passage = " ".join(rnd.choices(WORDS, k=30))
    out = [None, "", " ", "a", "the of", "ÄÖ ü ß\t\n été " * 9, "x" * 400, "x" * 400, "The OF and\x0bto", "the of AND to"]
    base = [rnd.choice(WORDS) for _ in range(120)]
    while len(out) < n:
        kind = rnd.randrange(5)
        words = [rnd.choice(WORDS) + str(rnd.randrange(300)) for _ in range(rnd.randrange(1, 150))]
        if kind == 0:
            words = list(base)
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(len(words))] = rnd.choice(WORDS) + str(rnd.randrange(50))
        elif kind == 1:
            words[rnd.randrange(len(words)) : 0] = [passage]
        elif kind == 2 and rnd.random() < 0.3:
            out.append(out[rnd.randrange(len(out))])
            continue
        out.append(" ".join(words))
    return out


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, bucket int, block long, node string").repartition(3)


def frame(spark, n, seed=1):
    rows = [(i, t, 1, 2, "x") for i, t in enumerate(texts(n, seed))]
    random.Random(seed).shuffle(rows)
    return rows, documents(spark, rows)


def removed(rows, length):
    first, out = {}, {}
    for doc_id, text in sorted((r[0], (r[1] or "").encode()) for r in rows):
        gone = [False] * len(text)
        for i in range(len(text) - length + 1):
            if first.setdefault(text[i : i + length], doc_id) < doc_id:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [24, 50, 53])
def test_suffix_dedup_equals_brute_force(spark, length):
    rows, docs = frame(spark, 90)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, length).collect()}
    assert got == removed(rows, length)


def test_suffix_dedup_edges(spark):
    long = "abc def " * 20
    docs = documents(spark, [(None, long, 0, 0, ""), (7, long, 0, 0, ""), (7, long, 0, 0, ""), (9, long + "z", 0, 0, "")])
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [(-1, 0), (7, 0), (7, 0), (9, 160)]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_windows_are_split_by_bytes_where_hashes_meet(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "mix", lambda h: h * np.uint64(0))
    data = np.frombuffer(b"".join(bytes([65 + i]) * 50 for i in (0, 1, 0, 2)), np.uint8)
    starts = np.array([0, 50, 100, 150])
    assert suffix_dedup.repeated_windows(data, starts, np.array([5, 6, 7, 8]), 50).tolist() == [5, 6, 5, 8]
    assert suffix_dedup.equal_runs(data, starts, np.full(4, 50))[0].tolist() in ([0, 1, 0, 2], [0, 1, 2, 3])


def linked(rows, words, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
        sets[doc_id] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {d: (len(sets[d]), label[d]) for d in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_ngram_join_equals_brute_force(spark, words, percent):
    rows, docs = frame(spark, 160, seed=words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs, words, percent).collect()}
    assert got == linked(rows, words, percent)


def test_ngram_join_edges(spark):
    text = "one two three four five six"
    docs = documents(spark, [(None, text, 0, 0, ""), (4, text, 0, 0, ""), (4, "other words here now", 0, 0, ""), (6, text, 0, 0, ""), (8, None, 0, 0, "")])
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.link_documents(docs).collect())
    assert got == [(-1, -1), (4, 4), (4, 4), (6, 4), (8, 8)]
    assert ngram_join.link_documents(docs.limit(0)).count() == 0


def test_prefix_choice_grows_with_cost():
    cheap, dear = np.array([1] * 5 + [2] * 95), np.array([1] * 5 + [5000] * 95)
    assert ngram_join.choose_matches(cheap, 100, 90)[1] - 10 == ngram_join.choose_matches(cheap, 100, 90)[0]
    assert ngram_join.choose_matches(dear, 100, 90)[0] >= 1


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components.components(edges).agg(F.max("label"), F.count("node")).first() == (0, 300)


def test_pii_is_consistent_and_distinct(spark):
    rows = [(1, "Mail Ann.7@mail.example.com and ANN.7@MAIL.EXAMPLE.COM, bob.7@mail.example.com", 0, 0, ""), (2, "4111 1111 1111 1111 is 4111111111111111; +1 (234) 567-8901 from 10.0.0.12", 0, 0, ""), (3, "Mrs Anna Schmidt, Mr. Иван Петров", 0, 0, ""), (4, None, 0, 0, ""), (4, "", 0, 0, ""), (5, "plain text 3.14 v1.2.3", 0, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_pii int, entity int, canonical string")
    got = {(r.doc_id, r.text is None): (r.text, r.n_pii) for r in pii.replace_pii(docs, "k").collect()}
    a, b, c = re.findall(r"\S+@[A-Za-z0-9.]+\w", got[1, False][0])
    assert a.lower() == b.lower() and b.isupper() and len({a.lower(), c.lower(), "ann.7@mail.example.com", "bob.7@mail.example.com"}) == 4
    assert a.split("@")[1] == c.split("@")[1] and a.endswith(".com") and re.fullmatch(r"[A-Z][a-z]{2}\.\d", a.split("@")[0])
    spaced, plain = re.match(r"(\d{4} \d{4} \d{4} \d{4}) is (\d{16});", got[2, False][0]).groups()
    assert spaced.replace(" ", "") == plain != "4111111111111111" and plain[0] == "4"
    assert sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(plain)) % 10 == 0
    assert re.search(r"; \+1 \(\d{3}\) \d{3}-\d{4} from \d\d\.\d\.\d\.\d\d$", got[2, False][0])
    assert re.fullmatch(r"Mrs [A-Z][a-z]+ [A-Z][a-z]+, Mr\. [А-Я][а-я]+ [А-Я][а-я]+", got[3, False][0])
    assert got[3, False][0].split()[1] in pii.FIRST["latin", "f"]
    assert got[4, True] == (None, 0) and got[4, False] == ("", 0) and got[5, False] == (rows[5][1], 0)
    assert pii.replace_pii(docs.limit(0), "k").count() == 0


def test_pii_collisions_are_derived_anew(spark):
    """All one-digit addresses have few surrogates, so many first choices collide."""
    rows = [(i, f"host {a}.{b}.1.1 up") for i, (a, b) in enumerate((a, b) for a in range(1, 10) for b in range(1, 10))] * 2
    found = pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").select("doc_id", "text").distinct().collect()
    assert len(found) == 81 == len({r.text for r in found}) and not {r.text for r in found} & {t for _, t in rows}


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "word é " * 300
    rows = [(1, "http://a/\r\nx%", big, 0), (2, None, big, 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u", "short", 0), (6, "u", "short", 0), (None, "n", big, 0), (2, "again", big, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, content int").repartition(3)
    folder = f"file://{tmp_path}/w"
    written = warc.write_archives(pages, folder)
    got = sorted((r.page_id or 0, r.url, r.record_type, r.payload_bytes, r.refers_to or 0, r.payload_digest) for r in warc.read_archives(spark, folder, written).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    n = len(big.encode())
    assert got == sorted([(1, "http://a/\r\nx%", "revisit", n, 2, sha(big)), (2, "", "response", n, 0, sha(big)), (2, "again", "response", n, 0, sha(big)), (0, "n", "revisit", n, 2, sha(big)), (3, "u", "response", 0, 0, sha("")), (4, "u", "response", 0, 0, sha("")), (5, "u", "response", 5, 0, sha("short")), (6, "u", "response", 5, 0, sha("short"))])
    empty = f"file://{tmp_path}/e"
    assert warc.read_archives(spark, empty, warc.write_archives(pages.limit(0), empty)).count() == 0


def test_urls_are_archived_as_they_are():
    for url in ("http://a/b%20c?d=%25", "http://a/%0A", "http://ä.example/ x", ""):
        record = warc.record_bytes(1, url, b"x", "d", None, "2024-01-01T00:00:00Z")
        assert f"WARC-Target-URI: {url}\r\n".encode() in record and warc.parse_record(record)["url"] == url
    for url in ("http://a/\r\nWARC-Type: x%0A", "\n"):
        record = warc.record_bytes(1, url, b"x", "d", 2, "2024-01-01T00:00:00Z")
        assert warc.parse_record(record)["url"] == url and warc.parse_record(record)["record_type"] == "revisit"


def test_archive_has_its_dictionary_first():
    records = [f"record {i} with common words and more common words {i}".encode() * 20 for i in range(300)]
    data = warc.build_archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and list(warc.read_archive(data)) == records
    assert list(warc.read_archive(warc.build_archive([b"x"]))) == [b"x"]


def test_fingerprints_equal_brute_force(spark):
    rows, docs = frame(spark, 120)
    got = {r.doc_id: r for r in fingerprints.compare_with_edited(docs, rows_per_bucket=7).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    for (doc_id, text, *_), (_, after, *_) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        made = fingerprints.edited(text, after)
        sets = [fingerprints.sketch(t.encode()) for t in (text, made, after)]
        marks = [fingerprints.fingerprint(t.encode(), s) for t, s in zip((text, made, after), sets)]
        row = got[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(made.encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == tuple(marks[:2])
        assert row.near_edited == fingerprints.likeness(sets[0], sets[1], marks[0] == marks[1]) and row.near_next == fingerprints.likeness(sets[0], sets[2], marks[0] == marks[2])
    assert fingerprints.compare_with_edited(docs.limit(0)).count() == 0
    alone = fingerprints.compare_with_edited(documents(spark, [(None, "abc", 0, 0, "")])).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in alone] == [(None, 3, 1.0)]


def test_sketches_merge_and_estimate_containment():
    rnd = random.Random(3)
    whole = bytes(rnd.randrange(97, 123) for _ in range(60_000))
    part = whole[:20_000]
    a, b = fingerprints.sketch(part), fingerprints.sketch(whole)
    assert fingerprints.containment(a, b) > 0.98 and abs(fingerprints.likeness(a, b, False) - 1 / 3) < 0.05
    rest = fingerprints.sketch(whole[20_000 - 11 :])
    marks = [fingerprints.fingerprint(b"", s) for s in (a, rest)]
    assert fingerprints.merge(marks) == fingerprints.fingerprint(b"", b)


def test_toxicity_finds_held_out_rows(spark):
    rnd = random.Random(5)
    bad = ["vile", "nasty", "awful"]
    rows = []
    for i in range(800):
        toxic = i % 7 == 0
        words = rnd.choices(WORDS, k=60) + (rnd.choices(bad, k=rnd.randrange(1, 9)) if toxic else [])
        rnd.shuffle(words)
        rows.append((i, " ".join(words).upper() if i % 3 else "! ".join(words), int(toxic), 0.0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, severity double")
    labels = docs.select("doc_id", "toxic").where("doc_id % 2 = 0").union(spark.createDataFrame([(None, 1), (0, None), (999, 1)], "doc_id long, toxic int"))
    model = toxicity.train(docs, labels)
    judged = toxicity.score(docs.union(spark.createDataFrame([(None, None, 0, 0.0)], docs.schema)), model).collect()
    assert len(judged) == 801 and not any(r.rejected for r in judged if not r.toxic)
    held_out = [r.rejected for r in judged if r.toxic and r.doc_id % 2]
    assert sum(held_out) / len(held_out) >= 0.9
    assert (np.diff(model.thresholds) > 0).all() and all(0 <= r.severity <= len(model.thresholds) for r in judged)
    mild, harsh = (r.severity for r in toxicity.score(spark.createDataFrame([(1, "so vile"), (2, "vile nasty awful vile nasty awful")], "doc_id long, text string"), model).orderBy("doc_id").collect())
    assert mild < harsh
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, nothing).where("rejected").count() == 0


def test_ordinal_fit_recovers_order():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 4, 600)
    grades = np.minimum(x, 2)
    model = toxicity.fit_severity(np.arange(600), np.zeros(600, np.int64), x.astype(float), grades, np.array([0]), ridge=0.01)
    chances = model.above(model.weights[0] * np.arange(4.0))
    assert (np.diff(chances.sum(axis=1)) > 0).all() and (chances[:, 0] >= chances[:, 1]).all()


def test_mixture_rates_and_edges(spark):
    rows = [(i, "a" if i < 3000 else ("b" if i < 3900 else None), 5) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_copies int")
    mixed = poisson_mix.mix_sources(docs, weights={"a": 1.0, "b": 1.0, None: 2.0}, size=8000)
    got = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(got["a"] - 2000) < 200 and abs(got["b"] - 2000) < 200 and abs(got[None] - 4000) < 300
    keys = [r.mix_key for r in mixed.collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert poisson_mix.mix_sources(docs, weights={"a": 1.0}).where("source = 'b'").count() == 0
    assert poisson_mix.mix_sources(docs.limit(0)).count() == 0
    big = poisson_mix.mix_sources(docs.limit(4), weights={"a": 1.0}, size=1200.0).groupBy("doc_id").count().collect()
    assert all(200 < r["count"] < 400 for r in big)


def test_vector_search_recall_and_edges(spark):
    rnd = np.random.default_rng(2)
    data = rnd.normal(size=(1500, 16)).astype(np.float32)
    data[1000:1400] = data[1000]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(data)] + [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [None] + [1.0] * 15, 0), (5080, [1.0], 0), (None, [1.0] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int")
    got = {}
    for r in vector_search.search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    x = data.astype(float)
    hits = 0
    for q in range(0, 1500, 20):
        scores = x @ x[q]
        order = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(scores[i], 9), i))[:20]
        hits += len({i for i, _ in got[q].values()} & set(order))
        assert sorted(got[q]) == list(range(1, 21))
        assert all(abs(s - x[i] @ x[q]) < 1e-9 for i, s in got[q].values())
    assert hits / (75 * 20) >= 0.9 and set(got) == set(range(0, 1500, 20))
    few = vector_search.search(table.where("vec_id < 3"), F.lit(True)).collect()
    assert len(few) == 6
    assert vector_search.search(table.limit(0), F.lit(True)).count() == 0


def test_bpe_equals_tiktoken(spark):
    ranks = bpe.read_ranks(RANKS)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    alphabet = "ab \n\t\r\x1c\x85\xa0\u3000'stéßж中😀1٣²_-<|endoftext|>\x00"
    awkward = ["".join(rnd.choices(alphabet, k=rnd.randrange(60))) for _ in range(300)] + ["a" * 3000, "The quick brown fox's don't", *[t for t in texts(60) if t is not None]]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(awkward)] + [(None, None, 0)], "doc_id long, text string, ids int")
    for row in bpe.decode_ids(bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect():
        text = "" if row.doc_id is None else awkward[row.doc_id]
        assert row.ids == reference.encode_ordinary(text) and bytes(row.decoded) == text.encode()
    digests = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert digests[5].decoded_sha256 == hashlib.sha256(awkward[5].encode()).hexdigest() and digests[None].n_tokens == 0
    assert digests[5].ids_sha256 == hashlib.sha256(np.array(reference.encode_ordinary(awkward[5]), "<u4").tobytes()).hexdigest()


def test_bpe_holds_few_pieces_and_merges_at_once(monkeypatch):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(["ab", "cdx", "Zq7", "é", "...", "thanen"], k=40_000)) for _ in range(24)]
    own = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    tracemalloc.start()
    for _ in own.encode_batch(texts):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 3 << 20 and peak < 32 << 20
    monkeypatch.setattr(bpe, "KEPT_MERGES", 50)
    own = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for n in range(60):
        text = f"thanen {' '.join(''.join(rnd.choices('qzxkvé', k=9)) for _ in range(20))} thanen"
        assert [a.tolist() for a in own.encode_batch([text])] == [reference.encode_ordinary(text)]
        assert " thanen" in own.merged and len(own.merged) + len(own.older) <= 2 * (50 + 21)


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(i).encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.index.tolist()) == list(range(5000)) and table.find(keys) == list(range(5000))
    assert set(table.find([b"x" + k for k in keys])) == {-1}


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("host"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_cascade.build_cascade(keys.union(spark.createDataFrame([(None, True)], "key string, listed boolean")))
    assert len(cascade.levels) > 2
    assert keys.withColumn("found", cascade.lists(F.col("key"))).where("found <> listed").count() == 0
    assert sum(len(data) for data, _, _ in cascade.levels) < 20_000
    for listed in (True, False):
        one = url_cascade.build_cascade(keys.withColumn("listed", F.lit(listed)))
        assert keys.limit(50).where(one.lists(F.col("key")) != listed).count() == 0
    assert url_cascade.build_cascade(keys.limit(0)).levels == []
    with pytest.raises(ValueError, match="max_bytes"):
        url_cascade.build_cascade(keys, max_bytes=16)


def test_url_rules(spark):
    urls = {"http://A.Example.ORG/es/x?q": ("a.example.org", "/es/x", "example.org/es/", "block"), "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"), "ftp://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
            "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"), "http://x.com": ("x.com", "", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://bad.net/a#f://": ("bad.net", "/a", None, "block"), "a://b://c/d": ("b:", "//c/d", None, "allow")}
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge_urls(pages, rules, F.col("key") == "bad.net").collect()}
    assert got == urls
    assert url_cascade.judge_urls(pages.limit(0), rules, F.lit(True)).count() == 0


def shingle_sets(text, size=12):
    raw = text.encode()
    return {raw[i : i + size] for i in range(len(raw) - size + 1)} if len(raw) >= size else {raw} if raw else set()


def test_sketches_estimate_true_likeness():
    """Against the whole sets of shingles, on texts of different lengths and one inside another."""
    rnd = random.Random(12)
    words = [f"{rnd.choice(WORDS)}{rnd.randrange(90)}" for _ in range(4000)]
    errors = {"short": [], "medium": [], "long": [], "inside": []}
    for kind, least, most in (("short", 20, 100), ("medium", 100, 600), ("long", 600, 6000)):
        for _ in range(300):
            text = " ".join(rnd.choices(words, k=most // 4))[: rnd.randrange(least, most)]
            other = fingerprints.edited(text, " ".join(rnd.choices(words, k=most // 4)))
            a, b = fingerprints.sketch(text.encode()), fingerprints.sketch(other.encode())
            x, y = shingle_sets(text), shingle_sets(other)
            errors[kind].append(abs(fingerprints.likeness(a, b, text == other) - len(x & y) / len(x | y)))
            whole = " ".join(rnd.choices(words, k=3000)) + text + " ".join(rnd.choices(words, k=3000))
            z = shingle_sets(whole)
            errors["inside"].append(abs(fingerprints.containment(a, fingerprints.sketch(whole.encode())) - len(x & z) / len(x)) if len(a) else 0.0)
    means = {kind: sum(e) / len(e) for kind, e in errors.items()}
    assert means["short"] < 0.1 and means["medium"] < 0.06 and means["long"] < 0.03 and means["inside"] < 0.02, means


def test_sketches_of_parts_merge_to_that_of_all():
    rnd = random.Random(13)
    parts = [" ".join(rnd.choices(WORDS, k=60)).encode() for _ in range(5)]
    marks = [fingerprints.fingerprint(p, fingerprints.sketch(p)) for p in parts]
    both = np.unique(np.concatenate([fingerprints.sketch(p) for p in parts]))
    assert fingerprints.parse(fingerprints.merge(marks)).tolist() == both.tolist()
    assert all(fingerprints.parse(m).tolist() == fingerprints.sketch(p).tolist() for m, p in zip(marks, parts))


def test_very_long_texts(spark):
    """Texts of several MB, longer than a block, beside short ones."""
    rnd = random.Random(14)
    long = " ".join(f"{w}{i % 5003}" for i, w in enumerate(rnd.choices(WORDS, k=700_000)))
    assert len(long) > 1 << 22
    docs = documents(spark, [(1, long, 0, 0, ""), (2, long + " end", 0, 0, ""), (3, "a b c", 0, 0, "")])
    assert {r.doc_id: r.component_id for r in ngram_join.link_documents(docs).collect()} == {1: 1, 2: 1, 3: 3}
    marked = {r.doc_id: r for r in fingerprints.compare_with_edited(docs).collect()}
    assert marked[2].near_next > 0.99 and marked[3].near_next < 0.01
    digests = {r.doc_id: r.decoded_sha256 for r in bpe.round_trip(docs.where("doc_id < 3"), RANKS, public_tokenizers.PATTERN).collect()}
    assert digests[1] == hashlib.sha256(long.encode()).hexdigest()


def test_columns_named_like_internal_ones_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (None, None, "z", None)], "doc_id long, text string, _result string, _result_ string")
    encoded = bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN, digests=True)
    assert encoded.columns == ["doc_id", "text", "_result", "_result_", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert sorted((r["_result"], r["_result_"], r.n_tokens) for r in encoded.collect()) == [("x", "y", 2), ("z", None, 0)]
    kept = ngram_join.keep_one(docs.withColumn("row", F.lit(3)).withColumn("n", F.lit(4)), 3, 90)
    assert sorted((r["_result"], r.row, r.n) for r in kept.collect()) == [("x", 3, 4), ("z", 3, 4)]
