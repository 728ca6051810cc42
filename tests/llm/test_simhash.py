"""SimHash groups against fingerprints and distances by brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from orgpulse.llm import simhash


def fingerprint(text, size=3):
    """By counting the bits of every shingle's hash, one after another."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius):
    """The least place that links reach, of every value."""
    label = list(range(len(values)))
    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= radius and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, fp int, label string, mask int").repartition(3)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    base = rnd.choices(words, k=400)
    texts = [None, "", " \t", " ", "One TWO", "one  two\n", "a", "Ä ö ß x", "a\x0bb\x0cc\x1cd e", "x " * 900]
    for _ in range(120):
        copy = list(base)
        for _ in range(rnd.randrange(4)):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(rnd.choices(words, k=rnd.randrange(1, 60))) for _ in range(60)]
    rnd.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (7, texts[9]), (7, texts[9]), (None, "no other text is like this one")]


def expected(rows, radius=3):
    fps = [fingerprint(t) for _, t in rows]
    label = groups(fps, radius)
    least = {}
    for (i, _), g in zip(rows, label):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, f"{f:016x}", least.get(g), fps.count(f)) for (i, _), f, g in zip(rows, fps, label)), key=repr)


def grouped(spark, rows, **more):
    found = simhash.group_documents(documents(spark, rows), **more)
    assert found.columns == ["doc_id", "fingerprint", "component_id", "n_same"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_equals_brute_force(spark, rows):
    assert grouped(spark, rows) == expected(rows)


def test_radius(spark, rows):
    assert grouped(spark, rows, radius=0) == expected(rows, 0)
    assert grouped(spark, rows, radius=6) == expected(rows, 6)


def test_long_texts_are_hashed_in_slabs(spark, monkeypatch):
    rnd = random.Random(2)
    long = "".join(rnd.choices(["alpha ", "Beta\t", "x" * 900 + " ", "\n", "gamma"], k=4000))
    whole = fingerprint(long)
    monkeypatch.setattr(simhash, "SLAB_BYTES", 1000)
    monkeypatch.setattr(simhash, "SLAB_SHINGLES", 50)
    assert simhash.fingerprints([b"a b", long.encode(), b"", b"a b"], 3).tolist() == [fingerprint("a b"), whole, 0, fingerprint("a b")]


def test_very_long_text(spark):
    long = " ".join(f"w{i % 977}" for i in range(700_000))
    assert len(long) > 3 * simhash.SLAB_BYTES
    got = grouped(spark, [(5, long), (3, long)])
    assert [r[2:] for r in got] == [(3, 2), (3, 2)] and got[0][1] == f"{fingerprint(long):016x}"


def test_large_groups_are_split_without_losing_links(spark):
    """Values that agree in most bits, so that few of them share every run that could part them."""
    rnd = random.Random(5)
    base, weak = rnd.getrandbits(64), rnd.sample(range(64), 12)
    values = list({base ^ sum(1 << b for b in rnd.sample(weak, rnd.randrange(7))) for _ in range(500)} | {base ^ rnd.getrandbits(64) for _ in range(100)})
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    place = {simhash.signed(v): i for i, v in enumerate(values)}
    for radius in (1, 3):
        want = groups(values, radius)
        for size in (16, 64, 2048):
            links = [(place[r.a], place[r.b]) for r in simhash.link_fingerprints(frame, radius, size).collect()]
            label = simhash.union(np.arange(len(values)), np.array([a for a, _ in links]), np.array([b for _, b in links]))
            assert label.tolist() == want


def test_planes_abandon_and_count_exactly():
    rnd = np.random.default_rng(6)
    values = rnd.integers(0, 1 << 63, 128, dtype=np.uint64)
    values[1], values[70] = values[0] ^ np.uint64(0b111), values[0] ^ np.uint64(0b1111 << 8)
    links = simhash.group_links(np.array([0]), values, 3)
    assert [x.tolist() for x in links] == [[1], [0]]
    assert [x.tolist() for x in simhash.group_links(np.array([0]), values, 4)] == [[1, 70], [0, 0]]


def test_empty_table(spark, rows):
    assert grouped(spark, rows[:0]) == []
