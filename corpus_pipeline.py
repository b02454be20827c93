"""From raw documents to packed training sequences, in five stages that each do their whole input.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. Nothing but what a stage decides is lost: language identification drops texts
that it cannot read, the dedup stages keep one document of each group, personal data is replaced
in place, and packing lists every piece of every document left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import local

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm import exact, language, packing, pii, simhash
from tallyscope.llm.tables import fresh, written
from tallyscope.plans.shared import discard, written_paths

#: A text is rejected, as is ``und``, if its best language has a pooled probability below this many times
#: what each would have if they were all alike, or below ``ENOUGH`` where there are few languages. So a
#: text of three languages in equal parts stays, however many languages there are.
LEAST_TIMES = 1.2
ENOUGH = 0.3

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Intermediate tables of the stage before in this thread; they are of no use once its result is written.
_left = local()


def stage(function: Stage) -> Stage:
    """Delete the tables that the stage before left, unless ``docs`` still reads them.

    The first stage begins a new chain and leaves alone what belongs to another one's result.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        paths = getattr(_left, "paths", [])
        if function.__name__ != "identify_language" and paths:
            files = docs.inputFiles()
            if not any(path.split(":")[-1] in file for file in files for path in paths):
                discard(paths)
        before = written_paths()
        result = function(spark, docs, sf_dir)
        _left.paths = sorted(written_paths() - before)
        return result

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and those of no language; learns from all labelled rows."""
    name, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    languages = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang").distinct().count()
    least = min(ENOUGH, LEAST_TIMES / max(languages, 1))
    found = language.with_language(docs, F.lit(True), into=(name, score))
    return found.where((F.col(name) != language.UNDETERMINED) & (F.col(score) >= least)).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each group of op4: shingles of four words, fingerprints up to four bits apart."""
    return simhash.near_dedup(docs)


@stage
def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_pii(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = packing.pieces(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return packing.pack(cut)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", remove_personal_data),
    ("best-fit packing", pack_sequences),
]

#: A network, fingerprints and a tokenizer: no SQL. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage is written and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for _, step in STAGES[:-1]:
        here: list[str] = []
        docs = written(step(spark, docs, sf_dir), "stage", here)
        discard(before)
        before = here
    return STAGES[-1][1](spark, docs, sf_dir)
