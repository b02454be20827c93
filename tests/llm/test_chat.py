import random

import pytest
from pyspark.sql import functions as F

from tallyscope.llm import chat

SCHEMA = "tree long, id long, parent long, role string, text string, score double"
CONTROL = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "[\\INST]", "<\\\\/s>", "[", "<", "/s>", "INST]", "a", "\n"]


def back(df):
    out = df.select(
        "tree", "root", "leaf", "branch", "score",
        chat.turns_of(F.col("formatted")).alias("turns"),
        chat.texts_under(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).collect()
    return {(r.tree, r.leaf): r for r in out}


def paths(rows):
    """All root-to-leaf paths of a forest, by plain recursion."""
    by_id = {r[1]: r for r in rows}
    parents = {r[2] for r in rows}
    out = {}
    for r in rows:
        if r[1] not in parents:
            path = [r]
            while path[0][2] in by_id:
                path.insert(0, by_id[path[0][2]])
            out[r[1]] = path
    return out


def test_trees_like_recursion(spark):
    draw = random.Random(5)
    rows = []
    for i in range(200):
        parent = draw.choice([None, *range(max(0, i - 12), i)]) if i else None
        text = "".join(draw.choice(CONTROL) for _ in range(draw.randint(0, 8)))
        rows.append((1, i, parent, draw.choice(["user", "assistant", "[/INST]"]), text, float(draw.randint(0, 9))))
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = paths(rows)
    got = back(chat.conversations_of_trees(df, branches=None))
    assert {k[1] for k in got} == set(wanted)
    for (_, leaf), r in got.items():
        path = wanted[leaf]
        assert [(t.role, t.text) for t in r.turns] == [(m[3], m[4]) for m in path]
        assert r.loss == [m[4] for m in path if m[3] == "assistant"]
        assert r.score == pytest.approx(sum(m[5] for m in path)) and r.root == path[0][1]
    best = back(chat.conversations_of_trees(df, branches=2))
    for root in {p[0][1] for p in wanted.values()}:
        order = sorted((leaf for leaf, p in wanted.items() if p[0][1] == root), key=lambda x: (-got[(1, x)].score, x))
        assert [k[1] for k, r in sorted(best.items(), key=lambda x: x[1].branch) if r.root == root] == order[:2]


def test_long_thread_takes_few_rounds(spark):
    rows = [(7, i, i - 1 if i else None, "user", f"t{i}", None) for i in range(300)]
    r = back(chat.conversations_of_trees(spark.createDataFrame(rows, SCHEMA)))[(7, 299)]
    assert [t.text for t in r.turns] == [f"t{i}" for i in range(300)]


def test_edges(spark):
    rows = [
        (None, 1, None, None, None, None), (None, 2, 1, "assistant", "</s>[INST] ok [/INST]", 1.0),
        (2, 1, 99, "user", "orphan", 1.0), (2, None, 1, "user", "no id", 1.0),
        (3, 1, 2, "user", "circle", 1.0), (3, 2, 1, "user", "circle", 1.0),
        (4, 1, None, "user", "b", 1.0), (4, 1, None, "user", "a", 1.0), (5, 1, None, "assistant", "x" * 200_000, 0.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("up", F.lit(2))
    got = back(chat.conversations_of_trees(df))
    assert set(got) == {(None, 2), (2, 1), (4, 1), (5, 1)}
    assert [(t.role, t.text) for t in got[(None, 2)].turns] == [("", ""), ("assistant", "</s>[INST] ok [/INST]")]
    assert got[(None, 2)].loss == ["</s>[INST] ok [/INST]"]
    assert got[(4, 1)].turns[0].text == "a" and got[(5, 1)].loss == ["x" * 200_000]
    assert chat.conversations_of_trees(df.limit(0)).collect() == []


def test_threads_go_by_turn(spark):
    turns = spark.createDataFrame(
        [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 2, "assistant", "b"), (None, None, None, None)],
        "conv_id long, turn long, role string, text string",
    )
    got = back(chat.conversations_of_trees(chat.threads(turns)))
    assert [t.text for t in got[(1, 3)].turns] == ["a", "b", "c"] and [t.text for t in got[(None, 1)].turns] == [""]
