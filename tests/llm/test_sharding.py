import numpy as np
import pytest

from tallyscope.llm import sharding


@pytest.mark.parametrize("size", [1, 2, 3, 10, 255, 256, 1000, 65537])
def test_permutation_is_a_bijection_and_inverts(size):
    p = sharding.Permutation(size, seed=4)
    n = np.arange(size, dtype=np.uint64)
    out = p.forward(n)
    assert sorted(out.tolist()) == list(range(size)) and (p.inverse(out) == n).all()


def test_seeds_differ_and_neighbours_part():
    n = np.arange(10_000, dtype=np.uint64)
    a, b = sharding.Permutation(10_000, 1).forward(n), sharding.Permutation(10_000, 2).forward(n)
    assert (a != b).mean() > 0.99 and abs(np.corrcoef(n, a)[0, 1]) < 0.05


def test_shards_are_reproducible_and_computable(spark):
    rows = [(i, "t" * (i % 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(df.repartition(3), 7, seed=9).collect()}
    two = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(df.repartition(5), 7, seed=9).collect()}
    assert one == two
    assert all(sharding.row_at(500, 7, *one[i], seed=9) == i for i in range(0, 500, 50))
    sizes = [sum(s == k for s, _ in one.values()) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1


def test_edges(spark):
    rows = [(None, None, 1, 1)] * 40 + [(1, "", 1, 1), (1, "", 1, 1), (2, "é" * 100_000, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int, part int")
    out = sharding.shard_rows(df, 5).collect()
    assert len(out) == 43 and len({(r.shard, r.slot) for r in out}) == 43
    assert {r["size"] for r in out} == {16, 200_016} and {r.text_crc32 for r in out if r.doc_id is None} == {0}
    assert sharding.shard_rows(df.limit(0), 5).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_rows(df, 0)
