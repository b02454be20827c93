"""Registered queries against their SQL, or against plain Python where SQL cannot say it."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from checks.compare import TABLES, rows_of
from tallyscope.llm import bpe
from tallyscope.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def result(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SMALL).collect()}


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    names, got = rows_of(df.columns, df.collect())
    wanted = con.sql(SQL[name])
    assert (names, got) == rows_of(wanted.columns, wanted.fetchall())


def test_language(spark, texts, con):
    got = result(spark, "op2_language_id")
    langs = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    assert set(got) == set(texts)
    right = [r.lang_pred == langs[i] for i, r in got.items() if r.held_out]
    assert sum(right) / len(right) > 0.95
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1


def test_pii(spark, texts):
    from tests.llm.test_pii import brute, listed

    for i, r in result(spark, "op3_pii").items():
        base = brute(texts[i])
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert set(listed(base).split(",")) - {""} <= set(r.spans.split(","))


def test_simhash(spark, texts):
    from tests.llm.test_simhash import brute_components, brute_fingerprint

    got = result(spark, "op4_simhash_near_dedup")
    ids = sorted(texts)
    codes = [brute_fingerprint(texts[i]) for i in ids]
    assert [int(got[i].fingerprint, 16) for i in ids] == codes
    assert [got[i].component_id for i in ids] == brute_components(ids, codes)


def test_scores(spark, texts):
    got = result(spark, "op5_context_tree")
    counts = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    for i, r in got.items():
        tokens = [*words(texts[i]), None]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(base) and r.score < 0


def test_shards(spark, texts):
    got = result(spark, "op6_feistel_shards")
    per = {}
    for i, r in got.items():
        data = texts[i].encode()
        assert (r["size"], r.text_crc32, r.grown_shard) == (len(data) + 16, zlib.crc32(data), None)
        per.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in per.values())
    assert set(per) == set(range(40))
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1


def test_packing(spark, texts):
    rows = QUERIES["op7_best_fit_packing"](spark, SMALL).collect()
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    documents, sequences = {}, {}
    for r in rows:
        documents.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(documents) == set(texts)
    for i, pieces in documents.items():
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2]
        at = 0
        for k, p in enumerate(sorted(pieces, key=lambda p: p.piece)):
            assert (p.piece, p.start) == (k, at) and (k == 0 or p.length == 1024)
            own = np.array(ids[at : at + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(own)
            at += p.length
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= math.ceil(sum(r.length for r in rows) / 1024) * 1.02 + 1


def test_bpe(spark, texts):
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in result(spark, "op8_prefix_bpe").items():
        ids = np.array(library.encode_ordinary(texts[i]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


def test_hash_is_the_standard_one(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a b",)], "x string").select(F.xxhash64("x").alias("h"))
    assert df.first().h % 2**64 == xxhash.xxh64_intdigest(b"a b", 42)
