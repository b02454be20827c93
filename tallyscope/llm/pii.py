"""Personal data: fixed patterns, and bootstrapped extraction from the contexts they stand in.

Seeds are matches of the fixed patterns. Their contexts (words before and after) are lexical
patterns; edges join a pattern with the identifiers it surrounds. Scores go back and forth: a
pattern is as good as the identifiers it surrounds, an unknown identifier as good as the patterns
around it. Those that good patterns surround are found too, and act as seeds from then on.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.tables import written

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SPAN = "struct<start:int,kind:int,stop:int,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda sum_, i: sum_
        + F.when(i % 2 == 1, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
            F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substr(digits, i, F.lit(1)).cast("int"))
        ),
    )
    return total % 10 == 0


def _is_card(value: Column) -> Column:
    n = F.length(_digits(value))
    return F.when(n.between(14, 19), _luhn(value)).otherwise(F.lit(False))


@dataclass(frozen=True)
class Kind:
    """A fixed pattern. Quantifiers are possessive, and a match may only begin where a run of its
    first characters does (or where the last match ended): the same matches, in linear time."""

    name: str
    regex: str
    needs: str
    valid: object = None


#: The kinds, in the order in which they are listed.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]",
         lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "[0-9][ -]?[0-9]", _is_card),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]",
         lambda v: F.length(_digits(v)).between(10, 15)),
)
#: What an identifier of unknown kind looks like: groups of letters at most, then letters and digits
#: in groups, four digits or more.
UNKNOWN = Kind(
    "id", r"(?<![0-9A-Za-z_])(?:[A-Za-z]{1,8}+[-_./]?+){0,3}+[0-9](?:[-_./]?[0-9A-Za-z]){3,}+", "[0-9][-_./]?[0-9A-Za-z]",
    lambda v: (F.length(_digits(v)) >= 4) & (F.length(v) >= 5),
)
NAMES = [k.name for k in KINDS] + [UNKNOWN.name]

#: A pattern is trusted when the share of known identifiers among all it surrounds is this high, and
#: higher than around all other patterns, by the lower end of Wilson's interval (``Z`` deviations).
CONFIDENCE = 0.8
Z = 1.96
#: Code points of the pieces in which places of a long text are looked up, and members of an array
#: that are added up one after the other.
PIECE = 256
#: Rows of the graph that share a pattern, or an identifier, are shared out among this many tasks.
SALTS = 16


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(values: Column, zero: Column, add) -> Column:
    """For each member what ``add`` makes of all members before it.

    An array that grows by one member costs its length each time, so it is done piece by piece.
    """
    def each(piece: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            piece, start,
            lambda acc, v: F.struct(add(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )

    def in_pieces(all_: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest((F.size(all_) - 1).cast("int"), F.lit(0)), F.lit(PIECE))
        return F.transform(numbers, lambda i: F.slice(all_, i + 1, F.lit(PIECE)))

    def joined(pieces: Column) -> Column:
        totals = F.transform(pieces, lambda piece: F.aggregate(piece, zero, add))
        return F.flatten(F.zip_with(pieces, each(totals, zero), each))

    return _let(_let(values, in_pieces), joined)


def _pieces(text: Column) -> Column:
    """A text in pieces of ``PIECE`` code points: a place is found without a walk from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _between(pieces: Column, start: Column, stop: Column) -> Column:
    """The code points from ``start`` up to ``stop``."""
    first = F.floor(start / PIECE).cast("int")
    number = F.floor((stop - 1) / PIECE).cast("int") - first + 1
    there = F.array_join(F.slice(pieces, first + 1, F.greatest(number, F.lit(0))), "")
    return F.when(stop > start, F.substr(there, start - first * PIECE + 1, stop - start)).otherwise(F.lit(""))


def _matches(text: Column, number: int, kind: Kind) -> Column:
    """Valid matches with their places in code points, by the lengths of what lies between them."""
    gaps = F.transform(F.split(text, kind.regex, -1), lambda gap: F.length(gap))
    values = F.regexp_extract_all(text, F.lit(kind.regex), F.lit(0))

    def spans(parts: Column) -> Column:
        lengths = F.transform(parts, lambda part: part["gap"] + F.coalesce(F.length(part["value"]), F.lit(0)))
        placed = F.zip_with(
            parts, _before(lengths, F.lit(0), lambda at, length: at + length),
            lambda part, at: F.struct(
                (at + part["gap"]).alias("start"), F.lit(number).alias("kind"),
                (at + part["gap"] + F.coalesce(F.length(part["value"]), F.lit(0))).alias("stop"), part["value"].alias("value"),
            ),
        )

        def fine(span: Column) -> Column:
            there = span["value"].isNotNull()
            return there if kind.valid is None else there & kind.valid(span["value"])

        return F.filter(placed, fine).cast(f"array<{SPAN}>")

    found = _let(F.arrays_zip(gaps.alias("gap"), values.alias("value")), spans)
    return F.when(text.rlike(kind.needs), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _apart(spans: Column, others: Column) -> Column:
    """Those of ``others`` (of a higher kind, apart from each other) that overlap none of ``spans``, by start."""
    unknown, far = F.lit(len(KINDS)), F.lit((1 << 31) - 1)

    def kept(all_: Column) -> Column:
        # All are in order of their starts: the spans before reach up to ``reached``, the next begins at ``next``.
        reached = _before(
            F.transform(all_, lambda s: F.when(s["kind"] < unknown, s["stop"]).otherwise(F.lit(0))),
            F.lit(0), lambda a, b: F.greatest(a, b),
        )
        later = F.transform(F.reverse(all_), lambda s: F.when(s["kind"] < unknown, s["start"]).otherwise(far))
        following = F.reverse(_before(later, far, lambda a, b: F.least(a, b)))
        clear = F.zip_with(
            F.arrays_zip(all_.alias("s"), reached.alias("reached")), following,
            lambda x, next_: F.when(
                (x["s"]["kind"] == unknown) & (x["reached"] <= x["s"]["start"]) & (next_ >= x["s"]["stop"]), x["s"]
            ),
        )
        return F.filter(clear, lambda s: s.isNotNull())

    none = F.array().cast(f"array<{SPAN}>")
    found = _let(F.sort_array(F.concat(spans, others)), kept)
    return F.when(F.size(others) == 0, none).when(F.size(spans) == 0, others).otherwise(found)


def _contexts(pieces: Column, span: Column) -> Column:
    """Two lexical patterns of a span: the two words before it; the word before and the one after.

    Digits count as 0, and letters in lower case.
    """
    def plain(x: Column) -> Column:
        return F.regexp_replace(F.lower(x), "[0-9]", "0")

    left = plain(_between(pieces, F.greatest(span["start"] - 40, F.lit(0)), span["start"]))
    right = plain(_between(pieces, span["stop"], span["stop"] + 24))
    word = F.regexp_extract(left, r"(\S*\s*)$", 1)
    return F.array(
        F.concat(F.lit("2:"), F.regexp_extract(left, r"(\S*\s+\S*\s*)$", 1)),
        F.concat(F.lit("1:"), word, F.lit("_"), F.regexp_extract(right, r"^(\s*\S*)", 1)),
    )


def base_spans(docs: DataFrame, id_column: str, text_column: str, payload: bool = False) -> DataFrame:
    """id, ``spans`` (of the fixed kinds, by start and kind) and ``marks``: all identifiers, also
    unknown ones, with their contexts. Written once; ``row`` numbers the rows. Null: empty text."""
    columns = [F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text")]
    if payload:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("payload"))
    rows = docs.select(*columns)
    rows = rows.withColumns({k.name: _matches(F.col("text"), i, k) for i, k in enumerate(KINDS)})
    rows = rows.withColumn("unknown", _matches(F.col("text"), len(KINDS), UNKNOWN))
    spans = F.sort_array(F.concat(*[k.name for k in KINDS]))
    rows = rows.withColumn("spans", spans)
    rows = rows.withColumn("apart", _apart(F.col("spans"), F.col("unknown")))

    def marked(pieces: Column) -> Column:
        return F.transform(
            F.concat("spans", "apart"),
            lambda s: F.struct(
                s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"),
                F.when(F.length(s["value"]) > 64, F.sha2(s["value"], 256)).otherwise(s["value"]).alias("value"),
                _contexts(pieces, s).alias("contexts"),
            ),
        )

    some = F.size("spans") + F.size("apart") > 0
    marks = _let(F.when(some, _pieces(F.col("text"))).otherwise(F.array().cast("array<string>")), marked)
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("marks", marks)
    plain = F.transform("spans", lambda s: s.dropFields("value"))
    kept = ["row", "id", plain.alias("spans"), "marks", *(["payload"] if payload else [])]
    return written(rows.select(*kept), "pii")


def _least_share(known: Column, n: Column) -> Column:
    """Lower end of Wilson's interval for the share ``known / n``."""
    share = known / n
    half = Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))
    return (share + Z * Z / (2 * n) - half) / (1 + Z * Z / n)


def _salted(edges: DataFrame, key: str, other: str, values: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join on ``key``, in which the edges of one key are shared out by ``other``."""
    edges = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    return edges, values.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "salt"]


def discovered(found: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """(kind, value, score, round): values of unknown kind that patterns of high confidence surround.

    The graph of patterns and identifiers has one edge per pair, however often it occurs. Identifiers
    found in one round are known in the next, and it ends with the first round that finds no
    more. What a share has to exceed is that around all other patterns of the same form, so a
    context that tells nothing gives nothing away.
    """
    unknown = len(KINDS)
    edges = written(
        found.select(F.explode("marks").alias("m"))
        .select("m.kind", "m.value", F.explode("m.contexts").alias("pattern"))
        .distinct()
        .withColumn("known", (F.col("kind") < unknown)),
        "pii-edges",
    )
    results: list[DataFrame] = []
    while True:
        counts = edges.groupBy("pattern").agg(F.count_if("known").alias("known"), F.count("*").alias("n"))
        counts = written(counts.withColumn("form", F.substring("pattern", 1, 1)), "pii-patterns")
        whole = counts.groupBy("form").agg(F.sum("known").alias("all_known"), F.sum("n").alias("all_n"))
        chance = (F.col("all_known") - F.col("known") + 1) / (F.col("all_n") - F.col("n") + 2)
        patterns = (
            counts.where("known < n")
            .join(F.broadcast(whole), "form")
            .withColumn("trust", _least_share(F.col("known"), F.col("n")))
            .where((F.col("trust") >= confidence) & (F.col("trust") > chance))
            .select("pattern", "trust")
        )
        open_, trusted, keys = _salted(edges.where(~F.col("known")), "pattern", "value", patterns)
        new = open_.join(trusted, keys).groupBy("kind", "value").agg(F.max("trust").alias("score"))
        new = written(new.withColumn("round", F.lit(len(results) + 1)), "pii-round")
        results.append(new)
        if new.isEmpty():
            return reduce(DataFrame.unionByName, results)
        left, right, keys = _salted(edges, "value", "pattern", new.select(F.col("kind").alias("new_kind"), "value"))
        edges = written(
            left.join(right, keys, "left").select(
                "kind", "value", "pattern", (F.col("known") | F.coalesce(F.col("kind") == F.col("new_kind"), F.lit(False))).alias("known")
            ),
            "pii-edges",
        )


def _with_discovered(found: DataFrame) -> DataFrame:
    """``found`` with ``more``: the spans that the patterns add."""
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    values = written(discovered(found).select("kind", "value"), "pii-values")
    if values.isEmpty():  # then no text needs to be shuffled
        return found.drop("marks").withColumn("more", none)
    marks = found.select("row", F.explode("marks").alias("m")).where(F.col("m.kind") == len(KINDS))
    span = F.struct("start", "kind", "stop")
    more = (
        marks.select("row", "m.start", "m.kind", "m.stop", "m.value")
        .join(values, ["kind", "value"], "left_semi")
        .groupBy("row")
        .agg(F.collect_list(span).alias("more"))
    )
    return found.drop("marks").join(more, "row", "left").withColumn("more", F.coalesce("more", none))


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``spans`` and ``all_spans``.

    Both are arrays of (start, kind, stop): code points, end exclusive, kind the index in ``NAMES``,
    by start and kind. ``spans`` are the fixed kinds, ``all_spans`` those and the identifiers that
    contexts gave away. Null text counts as empty and has none; repeated rows get the same spans;
    an empty table gives an empty result. Other columns are not read.
    """
    found = _with_discovered(base_spans(docs, id_column, text_column))
    return found.select(
        F.col("id").alias(id_column), "spans", F.sort_array(F.concat("spans", "more")).alias("all_spans")
    )


def redact_pii(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind, as in ``<EMAIL>``.

    Spans that overlap are replaced together, by the kind that begins first. Null texts stay null;
    all other columns pass, whatever their names.
    """
    found = _with_discovered(base_spans(docs, text_column, text_column, payload=True))
    tags = F.array(*[F.lit(f"<{n.upper()}>") for n in NAMES])
    text = F.col(f"payload.`{text_column}`")
    # One more span ends the text; like any other it has a gap before it.
    last = F.struct(F.length(text).alias("start"), F.lit(-1).alias("kind"), F.length(text).alias("stop"))
    spans = F.concat(F.sort_array(F.concat("spans", "more")), F.array(last))

    def rewritten(pieces: Column) -> Column:
        def parts(all_: Column) -> Column:
            reached = _before(F.transform(all_, lambda s: s["stop"]), F.lit(0), lambda a, b: F.greatest(a, b))
            return F.zip_with(
                all_, reached,
                lambda s, at: F.when(
                    s["start"] >= at,
                    F.concat(
                        _between(pieces, at, s["start"]),
                        F.when(s["kind"] < 0, F.lit("")).otherwise(F.get(tags, s["kind"])),
                    ),
                ),
            )

        return F.array_join(_let(spans, parts), "")

    clean = _let(_pieces(text), rewritten)
    put = F.when((F.size("spans") > 0) | (F.size("more") > 0), clean).otherwise(text)
    return found.select(
        *[put.alias(c) if c == text_column else F.col(f"payload.`{c}`") for c in docs.columns]
    )
