import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.llm import lm


def grams_of(training, deep):
    """Counts of (context, byte) for every depth up to ``deep``."""
    counts = {}
    for t in training:
        data = b"\0" * 4 + t + b"\xff"
        for i in range(4, len(data)):
            for depth in range(deep + 1):
                key = (data[i - depth : i], data[i])
                counts[key] = counts.get(key, 0) + 1
    return counts


def direct(training, text, deep):
    """Context-tree weighting as defined, in plain recursion, over all contexts that occurred."""
    grams = grams_of(training, deep)
    inside = {c for c, _ in grams} | {b""}

    def bits(c, k, node):
        n = [0, 0]
        for (context, byte), count in grams.items():
            if context == c and byte >> (8 - k) == node:
                n[byte >> (7 - k) & 1] += count
        return n

    def evidence(n):
        g = math.lgamma
        return g(n[0] + 0.5) + g(n[1] + 0.5) - g(n[0] + n[1] + 1) - math.log(math.pi)

    def parts(c, k, node):
        return sum(weighted(x, k, node) for x in inside if len(x) == len(c) + 1 and x.endswith(c))

    def weighted(c, k, node):
        own = evidence(bits(c, k, node))
        return own if len(c) == deep else np.logaddexp(own, parts(c, k, node)) - math.log(2)

    total, data = 0.0, b"\0" * 4 + text + b"\xff"
    for i in range(4, len(data)):
        path = [data[i - d : i] for d in range(deep + 1)]
        path = path[: next((d for d, c in enumerate(path) if c not in inside), deep + 1)]
        for k in range(8):
            node, bit = data[i] >> (8 - k), data[i] >> (7 - k) & 1
            own = [(n[1] + 0.5) / (sum(n) + 1) for n in (bits(c, k, node) for c in path)]
            p = own[-1]
            for d in range(len(path) - 2, -1, -1):
                w = 1 / (1 + math.exp(parts(path[d], k, node) - evidence(bits(path[d], k, node))))
                p = w * own[d] + (1 - w) * p
            total += math.log10(p if bit else 1 - p)
    return total


TRAINING = ["abracadabra", "abacab", "", "\u00fcb", "abracadabra"]
OTHERS = ["abra", "xyz", "\0a", None, "abracadabrab\u00fc"]


@pytest.mark.parametrize("share", [1 << 21, 8, 1])  # all grams looked up, some, none
def test_tree_like_the_definition(spark, monkeypatch, share):
    monkeypatch.setattr(lm, "GRAM_SHARE", share)
    monkeypatch.setattr(lm, "CHUNK", 5)
    monkeypatch.setattr(lm, "ROWS", 3)
    texts = TRAINING + OTHERS
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.score_texts(df, F.col("doc_id") < len(TRAINING)).collect()}
    training = [t.encode() for t in TRAINING]
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(direct(training, (text or "").encode(), 4), rel=1e-5)


def test_next_bytes_sum_to_one():
    counts = np.random.default_rng(5).integers(0, 9, (256, 256)).astype(float)
    codes = (97 << 24 | 98 << 16) + np.arange(65536)  # the context ab, any byte, and all bytes after it
    down = lm._from_root(counts, lm._weigh(lm._depths(codes, counts.ravel()))[0])
    p = 10 ** lm._predict(codes, counts.ravel(), down).reshape(256, 256)
    assert np.allclose(p.sum(1), 1, atol=1e-9)


def test_tree_grows_with_the_text(spark):
    """Every context that occurs has its grams, however rare it is."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(40))) for i in range(400)]
    kept = []
    for n in (100, 400):
        df = spark.createDataFrame(rows[:n], "doc_id long, text string")
        found = lm.gram_scores(lm.corpus_counts(df.select(F.lit(True).alias("trained"), "text")))
        grams = {c + bytes([b]) for c, b in grams_of([t.encode() for _, t in rows[:n]], 4) if len(c) == 4}
        assert {r.code.to_bytes(5, "big") for r in found.collect()} == grams
        kept.append(len(grams))
    assert kept[1] > 3 * kept[0]


def test_texts_of_a_block_are_apart(spark):
    texts = ["", "some", "text", "", "some text here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    together = {r.doc_id: r.score for r in lm.score_texts(df.coalesce(1), F.col("doc_id") == 4).collect()}
    apart = {r.doc_id: r.score for r in lm.score_texts(df.repartition(5), F.col("doc_id") == 4).collect()}
    assert together == pytest.approx(apart) and together[0] == together[3] > together[1]


def test_edges(spark, monkeypatch):
    rows = [(1, "a B a", 1), (1, "a B a", 1), (2, None, 1), (3, "", 1), (None, "b new \n", 1), (9, "w " * 50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    for share, block in ((1_000_000, 4_000_000), (3, 5)):  # all words looked up; nearly all joined
        monkeypatch.setattr(lm, "SHARE", share)
        monkeypatch.setattr(lm, "BLOCK", block)
        out = lm.score_texts(df, F.col("doc_id") <= 3).collect()
        got = {r.doc_id: r for r in out}
        assert len(out) == 6
        # trained on a b a, a b a and two empty texts: a 4, b 2, end 4
        assert got[1].train_tokens == 10 and got[2].n_tokens == 1 and got[2].n_known == 1
        assert got[None].n_tokens == 3 and got[None].n_known == 2 and not got[None].trained
        base = [math.log10(x / 14) for x in (3, 1, 5)]
        assert got[None].base_score == pytest.approx(sum(base)) and got[9].n_known == 1
        assert got[1].score > got[None].score
    none = lm.score_texts(df, F.lit(False)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in none)
    assert lm.score_texts(df.limit(0), F.lit(True)).collect() == []
