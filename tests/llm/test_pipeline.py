"""The stages against what they must keep, and the whole run."""

import os
import random

import pytest

import corpus_pipeline
from tallyscope.llm.tables import written
from tests.llm.test_exact import brute as brute_groups
from tests.llm.test_pii import brute as brute_spans
from tests.llm.test_simhash import brute_components, brute_fingerprint

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")
def test_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), "test-stage")
        rows = docs.collect()
        if name == "best-fit packing":
            assert {r.doc_id for r in rows} == set(before)
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows)
        if name == "language ID":
            assert len(after) >= 0.99 * len(before) and all(after[i] == before[i] for i in after)
        elif name == "exact dedup":
            assert after == {g[0]: before[g[0]] for g in brute_groups(list(before.items())) if g[3]}
        elif name == "SimHash near-dedup":
            ids = sorted(before)
            wanted = set(brute_components(ids, [brute_fingerprint(before[i] or "") for i in ids]))
            assert after == {i: before[i] for i in wanted}
        else:
            assert set(after) == set(before)
            for i, text in before.items():
                if not brute_spans(text):
                    assert after[i] == text
                for a, _, b in brute_spans(text):
                    assert text[a:b] not in after[i]
        before = after
    runs = corpus_pipeline.run(spark, SMALL)
    assert runs.columns == docs.columns and runs.count() == docs.count()


def test_documents_of_many_languages_stay(spark):
    """Twelve languages, each of its own letters, and documents that mix three of them in equal parts."""
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéñøåçþ"
    draw = random.Random(4)

    def text_of(language):
        return " ".join("".join(draw.choice(letters[3 * language : 3 * language + 3]) for _ in range(5)) for _ in range(30))

    rows = [(i, text_of(i % 12), f"l{i % 12}") for i in range(240)]
    rows += [(1000 + i, " ".join(text_of(x) for x in (i, (i + 4) % 12, (i + 8) % 12)), None) for i in range(12)]
    rows += [(2000, "12 34", "l0"), (2001, None, "l0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows if r[0] < 2000}


def test_every_stage_takes_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "12", "en", None, 2)]
    rows += [(10 + i, f"some plain words in a row number {i} mail a{i}@b.co", "en", "s", 9) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, part, "")
            found = out.collect()
            assert part is docs or found == []
            if name != "best-fit packing":
                assert out.columns == docs.columns
