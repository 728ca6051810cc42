"""Token alignment against overlaps of all token pairs by brute force."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from orgpulse.llm import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    byte = {**{chr(x): x for x in plain}, **{chr(256 + i): x for i, x in enumerate(rest)}}

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes.fromhex(piece[3:5]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()

    return lambda t: [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, of_b(i)) for i in b.encode(t)]


def places(pieces):
    at, out = 0, []
    for i, data in pieces:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def expected(rows):
    encode_a, encode_b = tokens()
    found = []
    for doc_id, text in rows:
        a, b = (encode_a(text), encode_b(text)) if text else ([], [])
        if any(b"".join(d for _, d in side) != (" " + (text or "")).encode() for side in (a, b)):
            a = b = []
        a, b = places(a), places(b)
        links = [(i, j) for i, s, e in a for j, s2, e2 in b if s < e2 and s2 < e]
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        cuts = list(zip([0, *ends], ends))
        groups = ";".join("|".join(",".join(str(i) for i, s, e in side if s >= begin and e <= end) for side in (a, b)) for begin, end in cuts)
        found.append((doc_id, len(a), len(b), len(cuts), links, hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    count = Counter()
    for row in found:
        count.update(set(row[4]))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(n, best.get(i, 0))
    return sorted(((d, n_a, n_b, g, len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x), sha) for d, n_a, n_b, g, x, sha in found), key=repr)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "'s", "té", "ß", "ж", "中", "\U0001f600", "1", "١", "²", "<s>", "</s>", "<|endoftext|>", "the ", "tokenizer", "<0x41>", "\x00", "▁", " ", "ﬁ"]
    rows = [(i, "".join(rnd.choices(alphabet, k=rnd.randrange(1, 40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "an ▁ that no side keeps"), (204, "the cat sat " * 20), (204, "the cat sat " * 20), (None, "the cat"), (205, "the cat's")]
    rnd.shuffle(rows)
    return rows


def aligned(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n_a int, block string, code int").repartition(3)
    found = token_alignment.align_documents(docs, A, B, **more)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("block_chars", [200, 1 << 22])
def test_equals_brute_force(spark, rows, block_chars):
    want = expected(rows)
    assert aligned(spark, rows, block_chars=block_chars) == want
    assert 10 < sum(r[1] == 0 for r in want) < len(want) - 10


def test_very_long_text(spark):
    """Longer than a step and a block; the same text in two documents counts its pairs twice."""
    text = "the quick brown fox's tail, " * 150_000
    rows = aligned(spark, [(1, text), (2, text), (3, "the quick")])
    assert rows[0][1:] == rows[1][1:] and rows[0][1] > 600_000 and rows[0][3] > 600_000
    small = expected([(1, text[:2800]), (2, text[:2800]), (3, "the quick")])
    assert rows[2] == small[2]


def test_empty_table(spark, rows):
    assert aligned(spark, rows[:0]) == []


def test_ranks_encode_as_the_tokenizer_itself(rows):
    pair = token_alignment.Pair(A, B)
    texts = [t for _, t in rows if t] + ["a" * 5000, "1" * 999 + " " * 999 + "\n", "don't DON'T 'twas"]
    assert pair.ranked is not None
    ranked = pair.encode_a(texts)
    pair.ranked = None
    assert ranked == pair.encode_a(texts)


def test_other_kinds_of_tokenizers_are_not_ranked():
    assert token_alignment.rank_encoder(public_tokenizers.path("word_bpe_49k.json")) is None
