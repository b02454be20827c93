import numpy as np
import pytest
import xxhash

from tallyscope.llm import simhash
from tests.llm.test_queries import words


def brute_fingerprint(text):
    found = words(text)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, codes):
    parent = list(range(len(ids)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    codes = np.array(codes, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= 4):
            a, b = sorted((top(i), top(i + 1 + int(j))))
            parent[b] = a
    return [ids[top(i)] for i in range(len(ids))]


def test_gray_rank_counts_in_gray_order():
    n = np.arange(256, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("tile, searches", [(20, 200_000), (500, 30)])
def test_index_finds_every_link(spark, monkeypatch, tile, searches):
    """Clusters with up to six flipped bits, many within reach of one another; large tiles shared out."""
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "SEARCHES", searches)
    draw = np.random.default_rng(1)
    codes = set()
    for base in draw.integers(0, 2**63, 25):
        for _ in range(60):
            code = int(base)
            for bit in draw.integers(0, 64, draw.integers(0, 7)):
                code ^= 1 << int(bit)
            codes.add(code)
    signed = sorted(np.array(sorted(codes), np.uint64).view(np.int64).tolist())
    found = simhash.components(simhash.links(spark.createDataFrame([(c,) for c in signed], "code long")))
    got = dict(found.collect())
    wanted = brute_components(signed, [c % 2**64 for c in signed])
    assert {c: w for c, w in zip(signed, wanted) if c != w} == got


def test_one_tile_with_everything_alike():
    codes = np.uint64(12345) ^ (np.arange(2000, dtype=np.uint64) << np.uint64(3))
    a, b = simhash.GrayIndex(codes, codes[:0], 22).search()
    assert len(a) == 1999 and set(b.tolist()) == {int(codes.min())}


def test_edges(spark):
    schema = "doc_id long, text string, code string, row int, best int, fingerprint int"
    long_text = "word " * 60_000
    rows = [(5, None), (4, ""), (3, " \n "), (9, long_text), (8, long_text), (None, long_text), (7, "One two"), (7, "one  TWO")]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], schema)
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    zero, long_code, short = "0" * 16, f"{brute_fingerprint(long_text):016x}", f"{brute_fingerprint('one two'):016x}"
    assert got == sorted(
        [(i, zero, 3) for i in (3, 4, 5)] + [(i, long_code, 8) for i in (0, 8, 9)] + [(7, short, 7)] * 2
    )
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]
    assert simhash.near_duplicates(df.limit(0)).collect() == [] and simhash.near_dedup(df.limit(0)).collect() == []
