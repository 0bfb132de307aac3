from __future__ import annotations

import odd
import pytest
import tiktoken

from emberline.llm import token_counts as C

OTHER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module", params=[C.VOCABULARY, OTHER])
def vocabulary(request):
    return request.param


def encoder(path):
    return tiktoken.Encoding("own", pat_str=C.PATTERN, mergeable_ranks=C.read_ranks(path), special_tokens={}).encode_ordinary


def test_counts_are_those_of_the_encoder(spark, vocabulary):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encode = encoder(vocabulary)
    got = {r["doc_id"]: r for r in C.token_counts(docs, vocabulary).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]]["n_tokens"] == len(encode(r["text"]))
        assert 0 <= got[r["doc_id"]]["n_whole"] <= got[r["doc_id"]]["n_pretokens"] <= got[r["doc_id"]]["n_tokens"]


def test_each_proof_holds(vocabulary):
    ranks = C.read_ranks(vocabulary)
    encode = encoder(vocabulary)
    whole = C.whole_tokens(ranks)
    assert len(whole) > 20_000
    assert all(len(encode(t)) == 1 for t in whole)


def test_odd_documents(spark):
    encode = encoder(C.VOCABULARY)
    got = C.token_counts(odd.documents(spark)).collect()
    want = sorted(((r[0], None if r[1] is None else len(encode(r[1]))) for r in odd.rows()), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == want
    special = spark.createDataFrame([(1, "a <|endoftext|> b    c\r\n\r\n  d\x00e")], "doc_id long, text string")
    assert C.token_counts(special).first()["n_tokens"] == len(encode("a <|endoftext|> b    c\r\n\r\n  d\x00e"))
    assert C.token_counts(odd.empty(spark)).count() == 0


def test_what_was_merged_is_forgotten_at_a_bound(monkeypatch):
    monkeypatch.setattr(C, "REMEMBERED", 5)
    ranks = C.read_ranks(C.VOCABULARY)
    counter, encode = C.Counter(ranks, frozenset()), encoder(C.VOCABULARY)
    text = odd.prose(1, 300)
    assert counter.count(text)[0] == len(encode(text)) and len(counter.known) <= 5
