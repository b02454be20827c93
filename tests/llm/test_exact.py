import hashlib
import re

from tallyscope.llm import exact


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((i, text or ""))
    out = []
    for norm, members in groups.items():
        order = sorted(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[0], order[0][0], len(members), k == 0, digest) for k, m in enumerate(order)]
    return sorted(out, key=repr)


def groups(df):
    return sorted((tuple(r) for r in exact.duplicate_groups(df).collect()), key=repr)


def test_groups_like_brute_force_with_a_hot_text(spark):
    rows = [(i, "same old\ttext") for i in range(300)] + [(1000 + i, f"text {i % 70}") for i in range(200)]
    rows += [(2000, "sameoldtext"), (2001, "same  old  text "), (2002, None), (2003, ""), (2004, " \r\x0b\x0c"),
             (2005, "sa me"), (2006, "é" * 50_000), (2007, "é " * 50_000), (None, "text 3"), (1, "same old\ttext"),
             (2009, "sameold\xa0text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert groups(df) == brute(rows)


def test_splitters_spread_a_hot_text(spark):
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"cold {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sorted_ = exact._sorted_groups(df, "doc_id", "text", payload=False)
    sizes = [r["count"] for r in sorted_.where("hot").groupBy("salt").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 200


def test_texts_are_shuffled_once(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    for payload in (False, True):
        for rows in (df, df.unionAll(df.limit(1).crossJoin(spark.range(90)).select("doc_id", "text"))):
            found = exact._sorted_groups(rows.repartition(2), "doc_id", "text", payload).where("rank = 1")
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan


def test_dedup_keeps_whole_rows(spark):
    schema = "doc_id long, text string, id int, norm int, hot int, row string, digest string"
    rows = [(2, "a b", 1, 1, 1, "x", "y"), (1, "ab", 2, 2, 2, "x", "y"), (3, None, 3, 3, 3, None, None), (4, "c", 4, 4, 4, "", "")]
    rows += [(10 + i, "h o t" if i == 7 else "hot", 5, 5, 5, "", "") for i in range(50)]
    df = spark.createDataFrame(rows, schema)
    kept = exact.exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 17]
    assert exact.exact_dedup(df.limit(0)).collect() == [] and groups(df.limit(0)) == []
