import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tallyscope.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_ranks(PATH))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_odd_texts_like_the_library(library):
    _, words = bpe._in_worker(bpe.load_ranks(PATH), P.PATTERN, 1)
    draw = random.Random(1)
    letters = "ab  \n\t \x1c\x85\xa0　éßñ漢字😀'st'll 12٣!?#̀\0aaa,."
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(5000)]
    texts += ["", " ", "x" * 3000, "ab" * 2000, " " * 500, "<|endoftext|>", "a, b. c,", "\0 \0"]
    for text, ids in zip(texts, words(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)


def test_cache_is_bounded_and_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHED", 10)
    bpe._encoders.clear()
    _, words = bpe._in_worker(bpe.load_ranks(PATH), P.PATTERN, 2)
    words.block = 20
    texts = [f"some words, number {i} and {i * 7}. more {'y' * i}" for i in range(80)]
    assert [np.frombuffer(x, "<u4").tolist() for x in words(texts)] == list(map(library.encode_ordinary, texts))
    assert len(words.cache) < 60
    bpe._encoders.clear()


def test_every_prefix_has_its_encoding(encoder):
    data = "Unglaublichkeiten".encode()
    growing = bpe.Growing(encoder, data)
    for end in range(1, len(data)):
        assert encoder.back(data[:end], growing.last) == bpe.Growing(encoder, data[:end]).ids() or data[:end] in encoder.ranks


def test_appends_and_edits_are_exact_and_local(encoder):
    draw = random.Random(2)
    text = bytes(draw.choice(b"aeinrst") for _ in range(2000))
    growing = bpe.Growing(encoder)
    for at in range(0, len(text), 50):
        growing.append(text[at : at + 50])
    assert growing.ids() == encoder.encode(text) and growing.computed == len(text)
    for _ in range(60):
        a = draw.randint(0, len(growing.data) - 10)
        b, put = a + draw.randint(0, 5), bytes(draw.choice(b"aeinrst") for _ in range(draw.randint(0, 4)))
        wanted = growing.data[:a] + put + growing.data[b:]
        before = growing.computed
        growing.edit(a, b, put)
        assert growing.data == wanted and growing.ids() == encoder.encode(wanted)
        assert growing.computed - before < 200


def test_round_trip_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "Größe  zählt\n", "x"), (1, "Größe  zählt\n", "x"), (None, None, None), (3, "", ""), (4, "z" * 20_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode_ids(bpe.encode_texts(df, PATH, P.PATTERN), PATH).collect()
    assert sorted(((r.doc_id or 0), bytes(r.decoded).decode()) for r in out) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert bpe.encode_texts(df.limit(0), PATH, P.PATTERN).collect() == []
