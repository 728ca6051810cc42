"""The pipeline's stages, each against what its operator must do to its own input."""

import hashlib
import re

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from orgpulse.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{number}"
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(after.columns == corpus_pipeline.COLUMNS for _, after in stages[:-1])


def test_filtering_stages_only_drop_rows(stages):
    for before, after in stages[:2]:
        assert after.exceptAll(before).count() == 0 and 0 < after.count() <= before.count()


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    sets = {}
    for r in before.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.translate({c: c + 32 for c in range(65, 91)}))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
    label = {d: d for d in sets}
    for _ in sets:
        old = dict(label)
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    assert {r.doc_id for r in after.collect()} == {d for d in label if label[d] == d}


def test_personal_data_is_replaced_and_the_rest_stays(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[2])
    found = re.compile(r"\S+@\S+\.com|\+\d \(\d{3}\) \d{3}-\d{4}|\d{16}|\d+\.\d+\.\d+\.\d+")
    assert before.keys() == after.keys()
    for doc_id, row in before.items():
        own = found.findall(row.text)
        assert not any(entity in after[doc_id].text for entity in own)
        assert own or "token" in row.text.lower() or after[doc_id] == row


def test_tokens_are_those_of_the_mixture(stages):
    before, after = stages[4]
    assert before.count() == after.count()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.rank_path()), special_tokens={})
    text = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.n_tokens == len(encoding.encode_ordinary(text[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_token_ids_are_kept(stages):
    before, after = stages[4]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.rank_path()), special_tokens={})
    text = {r.doc_id: r.text for r in before.collect()}
    assert after.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    for r in after.collect():
        assert r.ids == encoding.encode_ordinary(text[r.doc_id]) and len(r.ids) == r.n_tokens
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r.ids)).hexdigest()


def test_one_row_of_repeated_rows_stays(spark):
    """Rows are chosen, not ids: repeats, repeats without an id, one id with two texts, and a copy under another id."""
    text, other = ("one two three four five six seven eight nine ten " * 2).strip(), "some other words that nothing else has in it"
    rows = [(1, text)] * 3 + [(None, text)] * 2 + [(2, text), (2, other), (None, other + " x y"), (None, "a b c d e f g h")] + [(None, "a b c d e f g h")] * 3 + [(5, ""), (5, ""), (None, None), (6, " \t"), (7, other + " or " + text)]
    docs = spark.createDataFrame([(i, t, "en", "web", 0, "r", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, n int").repartition(3)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(kept, key=repr) == sorted([(1, text), (2, other), (None, other + " x y"), (None, "a b c d e f g h"), (5, ""), (5, ""), (None, None), (6, " \t"), (7, other + " or " + text)], key=repr)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_mixture_moves_sources_to_their_weights(stages):
    before, after = stages[3]
    rows = {r.doc_id: r for r in before.collect()}
    counts = {r.source: r["count"] for r in before.groupBy("source").count().collect()}
    total, weight = sum(counts.values()), {s: n**0.5 for s, n in counts.items()}
    for r in after.collect():
        assert rows[r.doc_id] == r  # whole rows, as often as drawn
    for source, n in {r.source: r["count"] for r in after.groupBy("source").count().collect()}.items():
        want = total * weight[source] / sum(weight.values())
        assert abs(n - want) < 5 * want**0.5 + 2
