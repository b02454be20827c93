"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.exact import IGNORED

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is it for on as with was be by at "
    "der die und in den von zu das mit sich des auf ist ein nicht "
    "de la le et les des en un du une que est pour qui dans "
    "el los se del las por con no su para es al lo como"
).split()
WORD_GAP = "[ \\t-\\r]+"


@dataclass(frozen=True)
class Rule:
    """``least <= measure <= most``; a measure without a value (an empty text) breaks no rule."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The thresholds. Each measure is a column of ``measures``.
RULES = (
    Rule("mean_word_length", "mean_word_chars", 2, 20),
    Rule("symbol_ratio", "symbols_per_word", most=0.2),
    Rule("stop_word_ratio", "stop_words_per_word", least=0.005),
    Rule("duplicate_line_ratio", "dup_lines_per_line", most=0.4),
    Rule("repeated_word_ratio", "repeat_words_per_word", most=0.5),
)


def _windows(words: Column, count: Column, of: Column) -> Column:
    """Hash or text (``of``) of each window of three words, beside its position."""
    return F.when(count >= 3, F.transform(F.sequence(F.lit(0), count - 3), of)).otherwise(F.array())


def measures(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the counts and ratios that rules read, in a struct column ``m``.

    Words are runs of characters other than space and U+0009 to U+000D; null is an empty text.
    Windows of three words are first compared by hash; only texts with an equal hash compare the
    words themselves. Ratios of an empty text are null. ``m`` replaces a column of that name.
    """
    def word(i: Column, k: int) -> Column:
        return F.get(F.col("_words"), i + k)

    def hashed(i: Column) -> Column:
        return F.xxhash64(word(i, 0), word(i, 1), word(i, 2))

    def spelled(i: Column) -> Column:
        return F.struct(F.concat_ws(" ", word(i, 0), word(i, 1), word(i, 2)).alias("t"), i.alias("i"))

    text = F.col("_text")
    staged = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("_text"),
    )
    staged = staged.withColumn("_words", F.filter(F.split(text, WORD_GAP, -1), lambda w: w != ""))
    staged = staged.withColumn(
        "_lines", F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, IGNORED, "") != "")
    )
    count = F.size("_words")
    staged = staged.withColumn("_hashes", _windows(F.col("_words"), count, hashed))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    staged = staged.withColumn(
        "_sorted",
        F.when(repeats, F.sort_array(_windows(F.col("_words"), count, spelled))).otherwise(
            F.array().cast("array<struct<t:string,i:int>>")
        ),
    )
    same = lambda a, b: F.get(F.col("_sorted"), a)["t"] == F.get(F.col("_sorted"), b)["t"]
    at = F.filter(
        F.col("_sorted"),
        lambda x, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)),
    )
    staged = staged.withColumn("_at", F.sort_array(F.transform(at, lambda x: x["i"])))
    # A window covers three words, less those that the next repeated window covers again.
    covered = F.aggregate(
        F.transform(
            F.col("_at"),
            lambda i, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_at"), k + 1) - i, F.lit(3))),
        ),
        F.lit(0),
        lambda total, x: total + x,
    )
    low = F.transform(F.col("_words"), F.lower)
    stops = F.size(F.filter(low, lambda w: w.isin(*sorted(set(STOP_WORDS)))))
    length = F.length("_text")
    counts = {
        "n_words": count.cast("long"),
        "word_chars": F.length(F.translate(text, IGNORED, "")).cast("long"),
        "n_symbols": (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "n_stop_words": stops.cast("long"),
    }
    counted = staged.select("_row", F.struct(*[v.alias(k) for k, v in counts.items()]).alias("m"))

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(f"m.{b}") > 0, F.col(f"m.{a}") / F.col(f"m.{b}"))

    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() != "m"]
    return counted.select(
        *kept,
        F.struct(
            "m.*",
            ratio("word_chars", "n_words").alias("mean_word_chars"),
            ratio("n_symbols", "n_words").alias("symbols_per_word"),
            ratio("n_stop_words", "n_words").alias("stop_words_per_word"),
            ratio("n_dup_lines", "n_lines").alias("dup_lines_per_line"),
            ratio("n_repeat_words", "n_words").alias("repeat_words_per_word"),
        ).alias("m"),
    )


def compiled(rules: Sequence[Rule]) -> dict[str, Column]:
    """One boolean expression per rule over the struct ``m``."""
    found = {}
    for rule in rules:
        value = F.col(f"m.{rule.measure}")
        ends = [] if rule.least is None else [value >= rule.least]
        ends += [] if rule.most is None else [value <= rule.most]
        found[rule.name] = F.coalesce(reduce(and_, ends, F.lit(True)), F.lit(True))
    return found


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text_column: str = "text") -> DataFrame:
    """``docs`` with ``m`` (measures), ``failed`` (names of broken rules) and ``passed``.

    No shuffle, one scan. Null and empty texts have no ratios and break no rule; a caller that
    wants them out adds a rule on ``n_words``. Columns of these names are replaced, others pass.
    """
    tests = compiled(rules)
    failed = F.filter(
        F.array(*[F.when(~ok, F.lit(name)) for name, ok in tests.items()]) if tests else F.array().cast("array<string>"),
        lambda x: x.isNotNull(),
    )
    out = measures(docs, text_column).withColumn("failed", failed)
    return out.withColumn("passed", F.size("failed") == 0)
