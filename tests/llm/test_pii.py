"""Surrogates: forms of names and numbers, coreference, crowded shapes, awkward rows; held against a plain Python twin."""

import random
import re

import pytest

from orgpulse.llm import pii


@pytest.fixture(scope="module")
def replaced(spark):
    def run(texts, key="k"):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [(r.text, r.n_pii) for r in pii.replace_pii(docs, key).orderBy("doc_id").collect()]

    return run


def test_names_of_many_forms(replaced):
    texts = ["Dr Smith came", "Mr O'Brien came", "Mr J. Smith came", "Mr Juan Carlos Garcia came", "Mrs Smith-Jones came", "Prof. Dr. Anna von Braun's car", "Mr J.R. SMITH came", "Señorita Núñez came"]
    got = [t for t, _ in replaced(texts)]
    forms = [r"Dr X came", r"Mr O'X came", r"Mr [A-Z]\. X came", r"Mr X X X came", r"Mrs X-X came", r"Prof\. Dr\. X von X's car", r"Mr [A-Z]\.[A-Z]\. XX came", r"Señorita X came"]
    for text, new, form in zip(texts, got, forms):
        assert re.fullmatch(form.replace("XX", "[A-Z]{5,}").replace("X", "[A-Z][a-z]+"), new), new
        assert not set(re.findall(r"\w+", new)) & {"Smith", "Brien", "Juan", "Carlos", "Garcia", "Jones", "Anna", "Braun", "SMITH", "Núñez"}
    surname = got[0].split()[1]
    assert got[2].split()[2] == surname == got[4].split()[1].split("-")[0] == got[6].split()[2].capitalize()
    assert got[2].split()[1] != "J."


def test_coreference_in_and_across_documents(replaced):
    got = replaced(["Mrs Anna Schmidt called. Later Schmidt wrote; SCHMIDT's Anna, not Schmidts.", "Mr Ivan Petrov and Mr Petrov", "Schmidt alone stays", "Господин Петров. Петров пришёл"])
    first, last = re.match(r"Mrs (\w+) (\w+) called", got[0][0]).groups()
    assert got[0] == (f"Mrs {first} {last} called. Later {last} wrote; {last.upper()}'s {first}, not Schmidts.", 4)
    names = got[1][0].split()
    assert names[2] == names[5] != "Petrov" and names[1] in pii.FIRST["latin", "m"]
    assert got[2] == ("Schmidt alone stays", 0)
    assert re.fullmatch(r"Господин ([А-Я][а-я]+)\. \1 пришёл", got[3][0]) and got[3][1] == 2


def test_national_phone_numbers_and_scripts_without_spaces(replaced):
    texts = ["call (555) 123-4567 or 555-123-4567", "写信给ann@mail.example.com谢谢", "电话+86 138 1234 5678谢谢", "卡4111111111111111和10.0.0.12", "é4111 1111 1111 1111", "part 12-555-123-4567, 3.14, v1.2.3.4, 2024-01-02"]
    got = replaced(texts)
    one, two = re.fullmatch(r"call (\(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})", got[0][0]).groups()
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) != "5551234567"
    assert re.fullmatch(r"写信给[a-z]{3}@[a-z]{4}\.[a-z]{7}\.com谢谢", got[1][0]) and got[1][0] != texts[1]
    assert re.fullmatch(r"电话\+86 \d{3} \d{4} \d{4}谢谢", got[2][0]) and got[2][0] != texts[2]
    assert re.fullmatch(r"卡4\d{15}和\d\d\.\d\.\d\.\d\d", got[3][0]) and "4111111111111111" not in got[3][0]
    assert got[4][1] == 1 and got[5] == (texts[5], 0)


def test_crowded_shapes_still_get_distinct_surrogates(replaced):
    octets = [f"{i // 729 + 1}.{i // 81 % 9 + 1}.{i // 9 % 9 + 1}.{i % 9 + 1}" for i in range(4000)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    locals_ = [f"{c}@one.example" for c in letters + "0"]
    sites = [f"ann@{c}.example" for c in letters]
    people = [f"Mrs {a}{b}na Schmidt" for a in letters[:9].upper() for b in "aeiou"]
    texts = [f"host {o} up" for o in octets] + [f"mail {m} now" for m in locals_ + sites] + people
    got = [t for t, _ in replaced(texts)]
    assert len(set(got)) == len(set(texts)) == len(texts) and not set(got) & set(texts)
    words = [t.split()[1] for t in got]
    assert not set(words[:4000]) & set(octets)
    assert len({w.split("@")[1] for w in words[4000:-45]}) == 27 and len({w.split("@")[0] for w in words[4027:-45]}) == 26
    assert len(set(words[-45:])) == 45 and len({t.split()[2] for t in got[-45:]}) == 1


def test_random_texts_against_a_plain_twin(replaced):
    """The places of entities are those a plain reading finds; equal parts get equal surrogates, different ones different."""
    rnd = random.Random(3)
    people = [(t, f, s) for t in ("Mr", "Mrs", "Dr") for f in ("Anna", "Bob", "Carl") for s in ("Quist", "Rowe", "Stone", "Tate")]
    texts, plans = [], []
    for _ in range(200):
        plan = []
        for _ in range(rnd.randrange(12)):
            kind = rnd.randrange(5)
            t, f, s = rnd.choice(people)
            plan.append([("plain", rnd.choice(["we met", "it is 3.14", "nothing here", "Later on"])), ("name", (t, f, s)), ("bare", s), ("mail", f"{f.lower()}{rnd.randrange(4)}@{s.lower()}.example"), ("phone", f"555-123-{rnd.randrange(1000, 1020)}")][kind])
        texts.append("; ".join(" ".join(v) if k == "name" else v for k, v in plan))
        plans.append(plan)
    mapping = {}
    for (text, n), plan in zip(replaced(texts), plans):
        known = {v[2] for k, v in plan if k == "name"}
        count = 0
        for (kind, value), new in zip(plan, text.split("; ")):
            if kind == "plain" or kind == "bare" and value not in known:
                assert new == value
                continue
            count += 1
            if kind == "name":
                title, first, last = new.split()
                assert title == value[0]
                female = {"Mr": "m", "Mrs": "f"}.get(title, "f" if value[1].endswith("a") else "m")
                pairs = [(("first", female, value[1]), first), (("last", value[2]), last)]
            elif kind == "bare":
                pairs = [(("last", value), new)]
            elif kind == "mail":
                pairs = [(("mail", value), new), (("site", value.split("@")[1]), new.split("@")[1])]
            else:
                pairs = [((kind, value), new)]
            for old, made in pairs:
                assert mapping.setdefault(old, made) == made
        assert n == count
    assert len({(k[0], v) for k, v in mapping.items()}) == len(mapping)
    assert not {v for v in mapping.values()} & {k[-1] for k in mapping}


def test_awkward_rows_and_clashing_names(spark):
    long = "plain words " * 200000 + "Mr Abel Quist; " + "x" * 100000 + " Quist"
    schema = "doc_id long, text string, _found string, _attempts int, _hash int, _out string, n_pii string, hash int, part int, role int"
    rows = [(i, t, "f", 1, 2, "o", "n", 3, 4, 5) for i, t in [(1, None), (1, ""), (None, "Mrs Anna Rowe"), (None, "Mrs Anna Rowe"), (2, long), (3, "Mrs Anna Rowe and Mr Bob Rowe and Mr Carl Rowe and Mr Dan Rowe and Mr " + "B" + "o" * 50000)]]
    docs = spark.createDataFrame(rows, schema)
    out = pii.replace_pii(docs, "k")
    assert out.columns == [c for c in docs.columns if c != "n_pii"] + ["n_pii"]
    got = out.collect()
    assert all((r["_found"], r["_attempts"], r["_hash"], r["_out"], r["hash"], r["part"], r["role"]) == ("f", 1, 2, "o", 3, 4, 5) for r in got)
    assert sorted((r.text or "", r.n_pii) for r in got if r.doc_id == 1) == [("", 0), ("", 0)] and len(got) == 6
    assert len({(r.text, r.n_pii) for r in got if r.doc_id is None}) == 1
    new = next(r for r in got if r.doc_id == 2)
    assert new.n_pii == 2 and new.text.startswith("plain words " * 200000 + "Mr ") and "Quist" not in new.text
    assert pii.replace_pii(docs.limit(0), "k").collect() == []
