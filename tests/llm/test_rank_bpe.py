"""Byte-level BPE by ranks against the library."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import queries, rank_bpe
from tests.conftest import SF_DIR

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "   a   b ", "a\n\nb \n c", "\ta\t\tb", "日本語 テキスト😀 x", "don't   we'll 's", "<|endoftext|>", "\x00 null", "é café ÀÉ", "a" * 700, "ab" * 400 + " " * 30 + "z", "x   y　z", "½ ² x²", "’quote’ – dash…", "​́ ǅ ⅷ", "Жизнь прекрасна"]
ENCODER = rank_bpe.Encoder(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})


def ids(text):
    return np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist()


def test_pattern_is_the_public_one():
    assert rank_bpe.PATTERN == P.PATTERN


def test_query_over_the_whole_table_and_odd_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]

    def brute(doc_id, text):
        found = LIBRARY.encode_ordinary(text or "")
        return (doc_id is None, doc_id or 0, len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode_bytes(found)).hexdigest())

    def got(df):
        return sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())

    assert got(queries.op12_rank_bpe(spark, SF_DIR)) == sorted(brute(*r) for r in rows)
    rows = [*enumerate(ODD), (None, "no id"), (3, None), (3, "same id"), (3, "same id")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_tokens string, ids int")
    assert got(rank_bpe.digests(df, PATH)) == sorted(brute(*r) for r in rows)
    back = {(r.doc_id, bytes(r.decoded).decode()): r.ids for r in rank_bpe.tokens(df, PATH).collect()}
    assert all(back[i, t or ""] == LIBRARY.encode_ordinary(t or "") for i, t in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rank_bpe.digests(empty, PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab ", max_size=120), st.text("aeiounst", max_size=80), st.text("éüß日本😀 '", max_size=60)))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_table_of_known_words_keeps_results(monkeypatch):
    monkeypatch.setattr(rank_bpe, "KEPT", 50)
    monkeypatch.setattr(rank_bpe, "BATCH_BYTES", 40)
    pick = random.Random(3)
    enc = rank_bpe.Encoder(PATH)
    for _ in range(60):
        some = [" ".join("".join(pick.choice("abcdeo") for _ in range(pick.randint(1, 6))) for _ in range(20)) for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(some)] == [LIBRARY.encode_ordinary(t) for t in some]
    assert len(enc.known) <= 200


@pytest.mark.parametrize("text", ["a" * 200_000, "ab" * 100_000, "".join(random.Random(1).choices("etaoinshrdlu", k=150_000)), "日本" * 30_000])
def test_very_long_pre_tokens(text):
    began = time.time()
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert time.time() - began < 20
    assert ENCODER.decode(ENCODER.encode([text])[0]) == text.encode()


def test_queue_gives_ranks_in_order():
    pick = random.Random(7)
    queue = rank_bpe.RankQueue(50_256)
    assert [len(x) for x in queue.levels] == [786, 13, 1]
    expected = {}
    for _ in range(2000):
        rank = pick.randrange(50_256)
        place = pick.randrange(10**6)
        if rank in queue.buckets:
            queue.buckets[rank].append(place)
        else:
            queue.enter(rank, [place])
        expected.setdefault(rank, []).append(place)
    for rank in sorted(expected):
        assert queue.least() == rank
        assert queue.take(rank) == sorted(expected[rank])
    assert queue.least() == -1
