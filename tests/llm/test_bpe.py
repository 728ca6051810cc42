"""Merges side by side against a plain loop, tiktoken and the merge of a single piece."""

import random

import public_tokenizers
import pytest
import tiktoken

from orgpulse.llm import bpe


def plain(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(ranks[p] for p in parts)


def test_short_pieces_are_merged_side_by_side(monkeypatch):
    """Of thousands of unlike short words none is merged by itself; long ones are."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, rnd, alone = bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(9), []
    merge = bpe.merge_bytes
    monkeypatch.setattr(bpe, "merge_bytes", lambda piece, *rest: alone.append(piece) or merge(piece, *rest))
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzé中", k=rnd.randrange(7, 20))) for _ in range(6000)] + ["q" * 62, "q" * 63, "q" * 64, "qz" * 400]
    text = " ".join(words)
    assert [ids.tolist() for ids in own.encode_batch([text])] == [reference.encode_ordinary(text)]
    assert {len(p) for p in alone if len(p) > 63} == {64, 65, 801} and len(alone) < 200


def test_merges_are_those_of_any_ranks(monkeypatch):
    """Also of ranks that don't rise with the length of the entries, far apart, with bytes that are no entries."""
    monkeypatch.setattr(bpe, "SIDE_BY_SIDE", 1)
    monkeypatch.setattr(bpe, "PLACES", 256)
    for seed in range(60):
        rnd = random.Random(seed)
        entries = list({b"a", b"b", b"c"} | {bytes(rnd.choices(b"abc", k=rnd.randrange(2, 7))) for _ in range(40)})
        rnd.shuffle(entries)
        ranks = {e: i * 3 + 1000 * (seed % 2) for i, e in enumerate(entries)}
        pieces = [bytes(rnd.choices(b"abc", k=rnd.randrange(1, 70))) for _ in range(200)]
        assert bpe.merge_pieces(pieces, ranks, bpe.PairRanks(ranks)) == [plain(p, ranks) for p in pieces]
    ranks = {b"a": 0, b"ab": 1}
    assert bpe.merge_pieces([b"aab"], ranks, bpe.PairRanks(ranks)) == [(0, 1)] and bpe.merge_pieces([], ranks, bpe.PairRanks(ranks)) == []
    with pytest.raises(KeyError):
        bpe.merge_pieces([b"aba", b"b"], ranks, bpe.PairRanks(ranks))
    empty = bpe.PairRanks({})
    with pytest.raises(KeyError):
        bpe.merge_pieces([b"a"], {}, empty)
