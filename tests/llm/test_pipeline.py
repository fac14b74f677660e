from __future__ import annotations

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from dayrank.llm import bpe, decontaminate, pii, toxicity
from dayrank.session import fresh_path, materialize
from tests.llm.helpers import documents
from tests.llm.test_bpe import reference  # noqa: F401
from tests.llm.test_neardup import brute as components_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The documents after each stage."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], FOLDER), name))
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_return_documents(kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "byte_bpe"]
    for frame in kept[:-1]:
        assert frame.columns == corpus_pipeline.COLUMNS
        assert frame.schema == kept[0].schema
    for frame in kept[:-1]:
        assert all(r.n_chars == len(r.text) for r in frame.collect() if r.text is not None)


def test_each_stage_against_a_plain_version(spark, kept, reference):  # noqa: F811
    before, after = texts(kept[0]), texts(kept[1])
    model = toxicity.fit(kept[0], spark.read.parquet(f"{FOLDER}/labels.parquet"), held_out=None)
    calm = {r.doc_id for r in model.score(kept[0]).collect() if r.score < 0.5}
    assert after == {i: before[i] for i in calm} and len(after) < len(before)

    before, after = after, texts(kept[2])
    heads = {i for i, _, c in components_of(list(before.items()), 5, 80, 100) if i == c}
    assert after == {i: before[i] for i in heads} and len(after) < len(before)

    before, after = after, texts(kept[3])
    items = [(str(r.item_id), decontaminate.words(r.text.encode())) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    automaton, wanted = decontaminate.Automaton(items, decontaminate.WINDOW), {}
    for i, text in before.items():
        spans, _ = automaton.hits(decontaminate.words(text.encode()))
        if 2 * sum(b - a for a, b in spans) <= len(decontaminate.words(text.encode())):
            wanted[i] = decontaminate.cut(text.encode(), spans).decode()
    assert after == wanted
    assert not any(automaton.hits(decontaminate.words(t.encode()))[0] for t in after.values())

    assert texts(kept[4]) == texts(pii.pseudonymise(kept[3], corpus_pipeline.PII_KEY))
    final = texts(kept[4])
    rows = kept[5].collect()
    assert {r.doc_id for r in rows} == set(final)
    for r in rows:
        assert r.ids == reference.encode_ordinary(final[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(final[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, kept):
    columns = ("doc_id", "ids_sha256")
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).select(*columns).collect())) == sorted(
        map(tuple, kept[-1].select(*columns).collect())
    )


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "a b"), (1, None), (1, None), (2, ""), (3, "w " * 200_000), (4, "x y"), (4, "p q")]])
def test_odd_documents_pass(spark, rows):
    folder = fresh_path(spark, "tables")
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect())
    words = bpe.parsed(bpe.shared_vocabulary(spark, public_tokenizers.path(corpus_pipeline.VOCABULARY)).value, public_tokenizers.PATTERN)
    count = lambda t: len(words.encode([t or ""])[0])
    wanted = [(i is None, i or 0, count(t)) for i, t in dict.fromkeys(rows) if (i, t) != (4, "x y")]
    assert got == sorted(wanted)
