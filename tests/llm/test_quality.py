import random
import re

from tallyscope.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(covered),
    )


def test_measures_like_brute_force(spark):
    draw = random.Random(4)
    parts = ["a", "b", "the", "Ünïc", "#x", "|", "$", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\r\n", "😀", "\x0b"]
    texts = {i: " ".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for i in range(800)}
    texts |= {900: "", 901: " \n ", 902: "a b", 903: "a a a a", 904: "a b c a b c a b c", 905: "x" * 60_000,
              906: "w1 w2 w3 " * 3000, 907: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in quality.quality_rules(df).collect():
        m = r.m
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == brute(texts[r.doc_id] or ""), r


def test_thresholds_are_a_table(spark):
    df = spark.createDataFrame([(1, "the a b c"), (2, "### $$$ %%%"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: (r.passed, r.failed) for r in quality.quality_rules(df).collect()}
    assert out[2][0] is False and "symbol_ratio" in out[2][1] and out[3] == (True, [])
    own = [quality.Rule("short", "n_words", least=4)]
    assert {r.doc_id: r.failed for r in quality.quality_rules(df, own).collect()} == {1: [], 2: ["short"], 3: ["short"]}
    assert all(r.passed for r in quality.quality_rules(df, []).collect())


def test_one_projection_without_user_functions(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = quality.quality_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Pandas" not in plan


def test_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, "the a", 5, 6, "m")], "doc_id long, text string, _words int, _row int, m string")
    out = quality.quality_rules(df)
    assert out.columns == ["doc_id", "text", "_words", "_row", "m", "failed", "passed"]
    assert out.first()._words == 5 and quality.quality_rules(df.limit(0)).collect() == []
