import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.llm import minhash
from tests.llm.test_queries import words

SCHEMA = "doc_id long, text string, row long, root string, n long"


def brute_set(text):
    found = words(text or "")
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def brute(rows, least=85):
    """(id, size, component, kept) of each row."""
    sets = [brute_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    holders = {}
    for i, own in enumerate(sets):
        for shingle in own:
            holders.setdefault(shingle, []).append(i)
    for i, own in enumerate(sets):
        for j in {j for shingle in own for j in holders[shingle] if j > i}:
            both = len(own & sets[j])
            if 100 * both >= least * (len(own) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    best = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            best[find(i)] = min(best.get(find(i), own), own)
    whole = [best.get(find(i)) for i in range(len(rows))]
    return sorted(((r[0], len(s), c, r[0] is not None and r[0] == c) for r, s, c in zip(rows, sets, whole)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def families(draw):
    """Chains of near copies on both sides of the limit, exact copies, a large family, a shared line."""
    vocabulary = [f"w{i}" for i in range(500)]
    line = draw.choices(vocabulary, k=12)
    texts = []
    for base in range(25):
        own = draw.choices(vocabulary, k=draw.randint(15, 220))
        for _ in range(150 if base == 0 else 6):
            texts += [" ".join([*own, *line] if base % 3 else own)] * draw.choice([1, 1, 1, 3])
            own = list(own) if draw.random() < 0.7 else own
            for _ in range(draw.randint(0, max(1, len(own) // 60))):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
    ids = draw.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


def test_like_the_definition(spark):
    rows = families(random.Random(1))
    wanted = brute(rows)
    assert 30 < sum(r[3] for r in wanted) < len(rows) - 200
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(6)
    assert got(minhash.similar_groups(df)) == wanted


def test_keys_of_many_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT", 5)
    rows = families(random.Random(2))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.similar_groups(df)) == brute(rows)


def test_other_sizes_and_limits(spark):
    rows = families(random.Random(3))[:300]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.similar_groups(df, least=60)) == brute(rows, 60)


def template(draw, pages, own_words):
    body = draw.choices([f"w{i}" for i in range(5000)], k=200)
    return [(i, " ".join([*body, *(f"own{i}x{k}" for k in range(own_words))])) for i in range(pages)]


def test_pages_of_one_template_are_not_paired(spark):
    """At a similarity of 0.66 nothing is linked: neither the bands nor the exact join list the pairs."""
    rows = template(random.Random(4), 400, 50)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.similar_groups(df)) == brute(rows)
    plain = df.select(F.col("doc_id").alias("id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), "text")
    made = minhash._with_signatures(plain, 5, 85).select(
        F.col("id").alias("row"), "digest", "n", F.struct("text_key", "id").alias("rep"),
        F.slice("bits", -minhash.PACKED, minhash.PACKED).alias("low"),
    )
    links = minhash._Links(plain, made, 5, 85)
    assert minhash._by_prefix(links, df.select(F.col("doc_id").alias("row"), F.col("doc_id").alias("root"))).count() == 0


def test_exact_join_finds_every_pair_without_bands(spark, monkeypatch):
    """Every document in one bucket: what one member does not link is joined by rare shingles."""
    rows = [r for i, r in enumerate(families(random.Random(5))) if i % 2]
    real = minhash._linked

    def one_bucket(links):
        links.sets = links.sets.withColumn("keys", F.array(F.lit(1).cast("long")))
        real(links)

    monkeypatch.setattr(minhash, "_linked", one_bucket)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.similar_groups(df)) == brute(rows)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85, 0.95])
def test_low_bits_estimate_the_similarity(spark, share):
    draw = np.random.default_rng(int(share * 100))
    errors = []
    for _ in range(40):
        size = 400
        both = round(2 * size * share / (1 + share))
        values = draw.integers(0, 1 << 63, 2 * size - both, np.uint64)
        a, b = values[:size], values[size - both :]
        low = [minhash.signature(np.sort(x), 8)[-minhash.PACKED :].tolist() for x in (a, b)]
        errors.append((low, both / len(values)))
    df = spark.createDataFrame([(a, b, s) for (a, b), s in errors], "a array<long>, b array<long>, s double")
    chance = 1 / 16
    found = df.select(minhash.matches(F.col("a"), F.col("b")).alias("m"), "s").collect()
    off = [(r.m / minhash.MINIMA - chance) / (1 - chance) - r.s for r in found]
    assert abs(np.mean(off)) < 0.02 and np.max(np.abs(off)) < 0.12


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c d e f"), (None, "a b c d e f"), (9, "A B c\nd e f"), (4, "one two"), (5, "one  Two")]
    rows += [(6, "one two three"), (7, "x " * 500_000), (8, "x x x x x"), (8, "x x x x x"), (10, "Ä b c d e"), (11, "ä b c d e")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    assert got(minhash.similar_groups(df)) == brute(rows)
    assert minhash.similar_groups(df.limit(0)).collect() == []
    assert len(minhash.similar_groups(df.where("doc_id <= 3")).collect()) == 3
