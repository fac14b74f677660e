from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

from dayrank.llm import bpe
from dayrank.llm.catalog import QUERIES, VOCABULARY
from tests.conftest import SF
from tests.llm.helpers import documents

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def encoded(spark, docs):
    vocabulary = bpe.shared_vocabulary(spark, PATH)
    return bpe.decode(bpe.encode(docs, vocabulary, public_tokenizers.PATTERN), vocabulary)


def test_query_matches_the_library(spark, reference):
    texts = dict(zip(*pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    rows = QUERIES["op5_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_texts(spark, reference):
    r = random.Random(5)
    texts = ["", None, " ", "\n\n \t", "a", "é", "漢字", "á", "'s 's", "<|endoftext|>", "abcdefgh" * 9000, "ab" * 3, "ab" * 3]
    texts += ["".join(r.choice("abcé ß漢🙂\n\t'12.,sT") for _ in range(r.randint(0, 70))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "again")]
    found = encoded(spark, documents(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, tuple(r.ids), bytes(r.decoded)) for r in found) == sorted(
        (i is None, i or 0, tuple(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows
    )


def test_empty_table(spark):
    assert encoded(spark, documents(spark, [])).count() == 0


def test_null_and_unknown_ids(spark):
    vocabulary = bpe.shared_vocabulary(spark, PATH)
    frame = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(frame, vocabulary).collect()] == [b"", b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), vocabulary).collect()


def test_tree_of_a_long_piece_equals_trees_of_short_ones(reference):
    with open(PATH, "rb") as file:
        words = bpe.parsed(file.read(), public_tokenizers.PATTERN)
    for text in ("xyzzyx" * 30, "q" * 200, "ththththe" * 20):
        assert words.encode([text])[0] == reference.encode_ordinary(text)
