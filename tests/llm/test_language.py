import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.llm import language

EN = "the cat and the dog were in the house with that old hat of theirs. "
DE = "der Hund und die Katze waren mit dem alten Hut in dem großen Haus. "


@pytest.fixture(scope="module")
def model():
    draw = np.random.default_rng(0)

    def some(text):
        words = text.split()
        return " ".join(draw.permutation(words * 6)).encode()

    texts = [some(EN) for _ in range(40)] + [some(DE) for _ in range(40)]
    return language.train(texts, ["en"] * 40 + ["de"] * 40, steps=80)


def test_backpropagation_like_differences():
    """The gradient of every weight of a small network against finite differences."""
    draw = np.random.default_rng(1)
    data = draw.integers(0, 5, (6, 3)).astype(np.uint8)
    mask = (np.arange(6)[:, None] < np.array([6, 4, 1])).astype(float)
    table, state = draw.normal(size=(256, 12)), draw.normal(size=(4, 12))
    weight = draw.normal(size=(6, 4, 3))

    def loss():
        return sum((w * h).sum() for w, h in zip(weight, language._read(table, state, data, mask, None)))

    kept = []
    language._read(table, state, data, mask, kept)
    d_table, d_state = language._read_back(list(weight), kept, state, data, mask)
    for values, gradient in ((table, d_table), (state, d_state)):
        for place in [(a, b) for a in range(4) for b in range(12)]:
            old, step = values[place], 1e-6
            values[place] = old + step
            up = loss()
            values[place] = old - step
            down = loss()
            values[place] = old
            assert gradient[place] == pytest.approx((up - down) / (2 * step), abs=1e-4)


def test_positions_and_documents_agree(model):
    texts = [EN.encode() * 7, DE.encode(), b"x", b"", DE.encode() * 300]
    pooled = model.documents(texts)
    for text, p in zip(texts, pooled):
        each = model.positions(text)
        assert each.shape == (len(text), 2)
        if len(text):
            assert np.allclose(each.sum(1), 1, atol=1e-4) and np.allclose(each.mean(0), p, atol=1e-4)
    assert [model.languages[i] for i in pooled[[0, 1, 4]].argmax(1)] == ["en", "de", "de"]


def test_training_is_reproducible():
    texts, labels = [EN.encode(), DE.encode()] * 3, ["en", "de"] * 3
    a, b = (language.train(texts, labels, steps=3).weights.all() for _ in range(2))
    assert all((x == y).all() for x, y in zip(a, b))


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(language, "STEPS", 60)
    rows = [(i, (EN if i % 2 else DE) * 4 + str(i), "en" if i % 2 else "de", 1.0) for i in range(60)]
    rows += [(100, None, "en", 1.0), (101, "", None, 1.0), (102, "12 34 +", "de", 1.0), (103, EN * 3000, None, None), (103, EN * 3000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = language.with_language(df, F.col("doc_id") < 200, into=("lang_pred", "score_"))
    assert out.columns == [*df.columns, "lang_pred", "score_"]
    got = {r.doc_id: (r.lang_pred, r.score_) for r in out.collect()}
    assert out.count() == 65 and all(got[i] == ("und", 0.0) for i in (100, 101, 102)) and got[103][0] == "en"
    assert sum(got[i][0] == ("en" if i % 2 else "de") for i in range(60)) >= 57
    nothing = language.with_language(df, F.lit(None).cast("boolean"), into=("a", "b"))
    assert {r.a for r in nothing.collect()} == {"und"}
    assert language.with_language(df.limit(0), F.lit(True), into=("a", "b")).collect() == []


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 10)
    df = spark.range(3000).select(F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    texts, labels = language.sampled(df, "text", "lang")
    assert 2 <= len(texts) <= 10 and set(labels) == {"en"}
    assert max(map(len, texts)) <= language.SAMPLE_CHARS


def test_sample_has_every_label_whatever_its_copies(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 20)
    monkeypatch.setattr(language, "LANGUAGES", 3)
    hot = spark.range(20000).selectExpr("'copy of a text' text", "'hot' lang")
    others = spark.range(100).selectExpr("concat('other text ', id) text", "'hot' lang")
    more = spark.range(40).selectExpr("concat('text ', id) text", "concat('l', id % 5) lang")
    texts, labels = language.sampled(hot.unionAll(others).unionAll(more), "text", "lang")
    assert len(set(texts)) == len(texts) and set(labels) == {"hot", "l0", "l1", "l2", "l3", "l4"}
    assert labels.count("hot") == 10 and all(labels.count(f"l{i}") == 8 for i in range(5))
    again = language.sampled(more.unionAll(others).unionAll(hot).repartition(7), "text", "lang")
    assert again == (texts, labels)
