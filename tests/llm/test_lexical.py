import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyscope.llm import lexical

DOCS = "doc_id long, text string, item long, score int"


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n, total = len(found), sum(x[2] for x in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in found:
            m = 50 + (50 * size * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(draw, n_docs, n_items):
    words = [f"w{i}" for i in range(300)]
    share = [1 / (i + 1) for i in range(300)]
    items = [(i % 11, " ".join(draw.choices(words, share, k=draw.randint(1, 30)))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        text = draw.choices(words, share, k=draw.randint(1, 60))
        if i % 7 == 0:
            text += draw.choice(items)[1].split()
        docs.append((i, draw.choice([" ", ", ", "\n"]).join(text)))
    copies = [(10_000 + i, docs[14][1].upper()) for i in range(120)]  # more equal scores than ranks
    draw.shuffle(docs)
    return docs + copies, items


def test_like_the_definition(spark):
    docs, items = corpus(random.Random(1), 600, 40)
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k in (3, 50):
        assert got(lexical.search_items(frame, asked, k)) == brute(docs, items, k)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
    docs, items = corpus(random.Random(2), 200, 12)
    asked = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(lexical.search_items(frame, asked, 5)) == brute(docs, items, 5)


def test_whole_batches_are_left_out():
    """A topic per stretch of documents: most pairs of nodes are never scored, and nothing is lost."""
    draw = random.Random(3)
    n_terms, n_docs, k = 400, 4000, 10
    rows = [sorted(draw.sample(range(40 * (d // 400), 40 * (d // 400) + 40), 8)) for d in range(n_docs)]
    starts = np.arange(0, 8 * n_docs + 1, 8)
    worth = np.array([draw.randint(1, 1000) for _ in range(8 * n_docs)], float)
    flat = np.array(rows).ravel()
    items = [(np.array(draw.sample(range(40 * g, 40 * g + 40), 5)), np.array([draw.randint(1, 99) for _ in range(5)])) for g in range(10)]
    search = lexical.Search(items, n_terms, k, np.zeros(10))
    for at in range(0, n_docs, 1000):
        part = slice(8 * at, 8 * (at + 1000))
        tree = lexical.Documents(flat[part], worth[part], starts[:1001], n_terms)
        search.add(tree, np.arange(at, at + 1000), np.zeros(1000, bool))
    for item, score, _, ids in search.found():
        weight = np.zeros(n_terms)
        weight[items[item][0]] = items[item][1]
        every = (weight[flat] * worth).reshape(-1, 8).sum(1)
        first = np.lexsort((np.arange(n_docs), -every))[:k]
        assert ids.tolist() == first.tolist() and score.tolist() == every[first].tolist()
    assert search.scored < 0.2 * 10 * n_docs


def test_edges(spark):
    docs = [(1, None), (2, ""), (None, "red Fox"), (3, "red fox"), (3, "red fox"), (4, "x " * 700_000 + "fox"), (5, "..."), (6, "É é ÉÉ fox")]
    items = [(1, "FOX, fox red"), (2, None), (None, "é"), (1, "Fox"), (3, "absent"), (4, "fox " * 100_000)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS)
    asked = spark.createDataFrame([(*i, 7, 7) for i in items], "item_id long, text string, doc_id int, rank int")
    assert got(lexical.search_items(frame, asked, 4)) == brute(docs, items, 4)
    assert lexical.search_items(frame.limit(0), asked).collect() == []
    assert lexical.search_items(frame, asked.limit(0)).collect() == []
    assert lexical.search_items(frame.where("doc_id = 2"), asked).collect() == []


@pytest.mark.parametrize("stretch", [1, 7, 1 << 20])
def test_long_texts_are_cut_between_terms(monkeypatch, stretch):
    monkeypatch.setattr(lexical, "STRETCH", stretch)
    text = "One tWO, Ünï-three 4a\x00b\x7fc " * 30
    total, counts = lexical.counted(text)
    wanted = Counter(t.encode() for t in terms(text))
    assert total == sum(wanted.values()) and counts == wanted
