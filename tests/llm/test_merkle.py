import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyscope.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, at int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def steps(found, i):
    """(left siblings, right siblings) of each level."""
    for level in found[:-1]:
        run, slot = level[i - i % 3 : i - i % 3 + 3], i % 3
        yield run[:slot], run[slot + 1 :]
        i //= 3


def brute(rows, changed):
    """(id, leaf, subroot, root, proof, folded) of each row; ``changed`` gives the claimed values."""
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row[:5]), leaf(changed(row)[:5]), row[0]))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([m[2] for m in sorted(sources[s])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for i, (_, _, own, claimed, doc_id) in enumerate(sorted(sources[s])):
            way = [*steps(trees[s], i), *steps(top, at)]
            node = claimed
            for left, right in way:
                node = h(*left, node, *right)
            proof = h(*[x for left, right in way for x in (*left, *right)])
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], proof, node))
    return sorted(out, key=str)


def got(df):
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def no_ends(row):
    return (*row[:4], row[4] and row[4].replace("\n", ""))


def claimed():
    return {"text": F.translate("text", "\n", "")}


@pytest.mark.parametrize("height", [1, 2, 7])
def test_like_the_definition(spark, height):
    """Trees of one leaf, exact powers of three, chunks of one task and more, many sources."""
    draw = random.Random(height)
    sizes = {None: 4, "": 1, "a": 9, "b": 10, "é": 27, "z": 82, "~": 2, "B": 3, "10": 28, "9": 1}
    rows = []
    for source, n in sizes.items():
        for i in draw.sample(range(1000), n):
            text = draw.choice([None, "", "one\ntwo", "plain", "é\n" * 5])
            rows.append((i, source, draw.choice([None, "en"]), draw.choice([None, 7]), text, 1, 1))
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = merkle.manifest(df, claimed=claimed(), height=height)
    assert got(out) == brute(rows, no_ends)
    assert all(r.verified == (r.root == r.folded_root) for r in out.collect())


def test_edges(spark):
    rows = [(None, None, None, None, None, 1, 2), (None, None, None, None, None, 1, 2), (5, "s", "en", 1, "a\nb", 1, 2)]
    rows += [(5, "s", "en", 1, "a\nb", 1, 2), (6, "s", "en", 2, "x" * 2_000_000, 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = merkle.manifest(df, claimed=claimed())
    assert got(out) == brute(rows, no_ends)
    assert sorted((str(r.doc_id), r.verified) for r in out.collect()) == [
        ("5", False), ("5", False), ("6", True), ("None", True), ("None", True)
    ]
    one = df.where("doc_id = 6")
    (only,) = merkle.manifest(one).collect()
    assert only.leaf == only.subroot == only.root == only.folded_root and only.proof_sha256 == h("") and only.verified
    assert merkle.manifest(df.limit(0)).collect() == []


def test_many_sources_are_joined_with_salt(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    rows = [(i, f"s{i % 7 if i % 3 else 0}", "en", i, f"text\n{i}", 1, 1) for i in range(200)]
    assert got(merkle.manifest(spark.createDataFrame(rows, SCHEMA), claimed=claimed())) == brute(rows, no_ends)


def test_proofs_stand_alone_and_states_are_taken_up(spark):
    rows = [(i, "abc"[i % 3], "en", i, f"text {i}", 1, 1) for i in range(100)]
    for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), proofs=True).collect():
        assert merkle.fold(r.leaf, r.proof) == r.root != merkle.fold(h("other"), r.proof)
    parent = merkle.Parent([b"a" * 64, b"b" * 64, b"c" * 64])
    assert parent.fold(1, b"x" * 64).decode() == h("a" * 64, "x" * 64, "c" * 64)
    assert [parent.fold(i, c) for i, c in enumerate(parent.children)] == [parent.digest] * 3
