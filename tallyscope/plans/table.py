"""The analysed table: typed columns, group keys, and small facts about it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from threading import Lock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope import rules
from tallyscope.plans.shared import discard, written

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Rows looked at on the driver to settle what a few values can already prove.
HEAD_ROWS = 2000
# Of these, rows whose values come along.
TOP_ROWS = 200
# Leading values that decide on the format of dates in text.
DATE_VALUES = 100
# Hashes in a bounded set, as powers of two: fewer distinct values are counted, more are estimated.
SET_BITS, WIDE_SET_BITS = 10, 14
# An estimate decides only if it is this many standard errors away from what it is compared with.
DEVIATIONS = 7
# Sets of this many groups of tasks are merged before the last task merges theirs.
SET_GROUPS = 64
# Longer texts are compared by a 128-bit digest, so that they are not shuffled.
DIGEST_LENGTH = 32


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, INTEGER_TYPES):
        return "integer"
    if isinstance(data_type, FLOAT_TYPES):
        return "float"
    if isinstance(data_type, T.DecimalType):
        return "decimal"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(data_type, TEMPORAL_TYPES):
        return "temporal"
    return "unsupported"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def field(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col(quoted(name))


#: Aggregation buffer fields of one scan. Spark compiles an aggregation into one generated loop only
#: below 100 fields, so facts are taken in batches that stay under.
FIELD_BUDGET = 96


@dataclass(frozen=True)
class Fact:
    """An aggregate over the rows of a group, and how many buffer fields it takes beside its column's others."""

    value: Column
    width: int


class Table:
    """A DataFrame prepared for analysis.

    NaN becomes null in float columns, nested and binary columns are left out (see
    ``unsupported``), and ``by`` names the group keys: every analysis is then made
    per group. Whether a column takes part in an analysis is decided on the whole
    table; thresholds on the number of values apply per group.
    """

    def __init__(self, df: DataFrame, by: Sequence[str] = (), keep: bool = False):
        self.by = list(by)
        self.keep = keep
        self._kept: dict[str, DataFrame] = {}
        self._paths: list[str] = []
        self._lock = Lock()
        self._locks: dict[str, Lock] = {}
        self.distinct_counts: dict[str, int] = {}
        self._declared: dict[str, Fact] = {}
        #: Numeric columns that the histogram of values sums per value, for a full analysis.
        self.summed: list[str] = []
        self._head: list[tuple] | None = None
        self._first: list[dict] = []
        self._first_is_all = False
        unknown = [k for k in self.by if k not in df.columns]
        if unknown:
            raise ValueError(f"group keys not in the table: {unknown}")
        self.source = df
        self.spark = df.sparkSession
        self.kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
        self.physical = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        self.unsupported = [c for c, k in self.kinds.items() if k == "unsupported"]
        self.columns = [
            c for c in df.columns if c not in self.by and self.kinds[c] != "unsupported"
        ]
        self.position = {c: i for i, c in enumerate(df.columns)}
        self.df = df.select(
            *[self._clean(c) for c in df.columns if c in self.by or c in self.columns]
        )

    def _clean(self, name: str) -> Column:
        if self.kinds[name] == "float":
            value = field(name)
            return F.when(~F.isnan(value), value).alias(name)
        return field(name)

    def _of_kind(self, *kinds: str) -> list[str]:
        return [c for c in self.columns if self.kinds[c] in kinds]

    @property
    def numeric(self) -> list[str]:
        return self._of_kind("integer", "float", "decimal")

    @property
    def integers(self) -> list[str]:
        return self._of_kind("integer")

    @property
    def strings(self) -> list[str]:
        return self._of_kind("string")

    @property
    def keys(self) -> list[Column]:
        return [field(k) for k in self.by]

    def declare(self, wanted: Mapping[str, Fact]) -> None:
        """Say that these facts will be asked for: all declared ones are gathered together."""
        self._declared |= wanted

    def facts(self, wanted: Mapping[str, Fact]) -> DataFrame:
        """(keys, one column for each fact): one row per group.

        Declared facts come from the scans that all operators share, others from scans of their own.
        """
        if self.keep and wanted.keys() <= self._declared.keys():
            shared = self.kept("facts", lambda: self._gathered(self._declared))
            return shared.select(*self.keys, *map(field, wanted))
        return self._gathered(wanted)

    def _gathered(self, wanted: Mapping[str, Fact]) -> DataFrame:
        columns: dict[str, list[str]] = {}
        for name in wanted:  # aggregates of one column share buffers
            columns.setdefault(name.rpartition("_")[2], []).append(name)
        parts: list[list[str]] = [[]]
        used = 0
        for names in columns.values():
            width = sum(wanted[n].width for n in names)
            if used + width > FIELD_BUDGET and parts[-1]:
                parts.append([])
                used = 0
            parts[-1] += names
            used += width
        found = [self.df.groupBy(*self.keys).agg(*[wanted[n].value.alias(n) for n in part]) for part in parts]
        if len(found) == 1:
            return found[0]
        if not self.by:
            row = [v for df in found for v in df.first()]
            return self.spark.createDataFrame([row], T.StructType([f for df in found for f in df.schema.fields]))
        return reduce(lambda a, b: join_on(a, b, self.by), [written(df, "facts") for df in found])

    @cached_property
    def rows(self) -> int:
        """Number of rows; on Parquet Spark answers this from the file footers."""
        return self.source.count()

    def _look(self) -> None:
        """One ``take`` for all that a few leading rows can tell: hashes of 2,000 rows, values of the first."""
        with self._lock:
            if self._head is not None:
                return
            place = F.monotonically_increasing_id()
            hashed = [F.xxhash64(field(c)).alias(f"h{i}") for i, c in enumerate(self.columns)]
            empty = [field(c).isNull().alias(f"e{i}") for i, c in enumerate(self.columns)]
            values = [F.when(place < TOP_ROWS, field(c)).alias(f"v{i}") for i, c in enumerate(self.columns)]
            found = self.df.select(place.alias("place"), *hashed, *empty, *values).take(HEAD_ROWS)
            width = len(self.columns)
            self._head = [r[1 : 1 + 2 * width] for r in found]
            first = [dict(zip(self.columns, r[1 + 2 * width :])) for r in found if r[0] < TOP_ROWS]
            # The first rows of the table are those of its first partition.
            self._first = first if [r[0] for r in found[: len(first)]] == list(range(len(first))) else []
            self._first_is_all = len(first) == len(found) < HEAD_ROWS

    def surely_more_than(self, column: str, limit: int) -> bool:
        """True if a few leading rows already show more than ``limit`` distinct values.

        Equal values have equal hashes, so the number of hashes never exceeds the
        number of values and a True is a proof; False says nothing.
        """
        self._look()
        i = self.columns.index(column)
        width = len(self.columns)
        return len({r[i] for r in self._head if not r[width + i]}) > limit

    def top(self, n: int) -> list[dict]:
        """The first rows by column, without the group keys."""
        self._look()
        with self._lock:
            if len(self._first) < n and not self._first_is_all:
                found = self.df.select(*map(field, self.columns)).take(n)
                self._first = [dict(zip(self.columns, r)) for r in found]
                self._first_is_all = len(found) < n
        return self._first[:n]

    def leading(self, columns: Sequence[str], n: int, width: int | None = None) -> dict[str, list]:
        """The first ``n`` non-null values of each column, in row order.

        One small ``take`` serves most columns; only columns that are mostly null at
        the top of the table are looked at again, each with its own filtered ``take``.
        """
        columns = list(columns)
        if not columns:
            return {}

        def value(c: str) -> Column:
            if width is not None and self.kinds[c] == "string":
                return F.substring(field(c), 1, width)
            return field(c)

        wanted = max(2 * n, 50)
        top = self.top(wanted)
        found = {}
        for c in columns:
            values = [r[c] for r in top if r[c] is not None][:n]
            if width is not None and self.kinds[c] == "string":
                values = [v[:width] for v in values]
            if len(values) < n and len(top) == wanted:
                rest = self.df.select(value(c).alias("v")).where("v is not null").take(n)
                values = [r.v for r in rest]
            found[c] = values
        return found

    @cached_property
    def date_formats(self) -> dict[str, str | None]:
        """For each string column the format that reads most of its leading values, if any.

        Among equals the one listed first; values are cut where no format could read them.
        """
        first = self.leading(self.strings, DATE_VALUES, width=200)
        named = [(c, x) for c, v in first.items() for x in v]
        formats: dict[str, str | None] = {c: None for c in self.strings}
        if not named:
            return formats
        probe = self.spark.createDataFrame(named, "name string, value string")
        reads = [
            F.count(F.try_to_timestamp("value", F.lit(f))).alias(f"read{i}")
            for i, f in enumerate(rules.DATE_FORMATS)
        ]
        for row in probe.groupBy("name").agg(*reads).collect():
            most = max(row[1:])
            if most:
                formats[row["name"]] = rules.DATE_FORMATS[row[1:].index(most)]
        return formats

    def moment(self, column: str) -> Column:
        """A date, timestamp or date-like string column as a zoneless timestamp."""
        if self.kinds[column] == "temporal":
            return field(column).cast("timestamp_ntz")
        text_format = self.date_formats.get(column)
        if text_format is None:
            return F.lit(None).cast("timestamp_ntz")
        # Read as UTC and counted up from a zoneless zero: the session's zone has hours that do
        # not exist, and would move local times that fall into them.
        read = F.try_to_timestamp(F.concat(field(column), F.lit(" +0000")), F.lit(f"{text_format} xx"))
        return zoneless(read)

    def kept(self, name: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """A result that several analyses read, computed once; rows are groups x columns.

        It is written to the shared folder, under a new name in every run: Spark's cache would
        take a file for the same as long as its path is.
        """
        with self._lock:
            lock = self._locks.setdefault(name, Lock())
        with lock:
            if name not in self._kept:
                self._kept[name] = written(compute(), "kept", self._paths)
        return self._kept[name]

    def is_kept(self, df: DataFrame) -> bool:
        return any(df is kept for kept in self._kept.values())

    def release(self) -> None:
        self._kept.clear()
        discard(self._paths)

    def low_cardinality(self, columns: Sequence[str], limit: int) -> dict[str, int | None]:
        """Exact distinct counts of the columns, or None where they exceed ``limit``.

        Leading rows may prove a column larger; of all others each task keeps the least hashes, up
        to a fixed number. A set that is not full holds all there are; a full one is proof of
        more, wherever in the table they stand. No value is shuffled.
        """
        open_columns = [
            c
            for c in columns
            if (c not in self.distinct_counts or 1 << SET_BITS < self.distinct_counts[c] <= limit)
            and not self.surely_more_than(c, limit)
        ]
        if open_columns and self.keep and set(open_columns) <= set(self.counted_columns()):
            self.distinct_counts.update(self._sizes())
        elif open_columns:
            bits = max(SET_BITS, (limit + 1).bit_length())
            self.distinct_counts.update(set_sizes(self, open_columns, bits))
        counts = {c: self.distinct_counts.get(c) for c in columns}
        return {c: n if n is not None and n <= limit else None for c, n in counts.items()}


    def counted_columns(self) -> list[str]:
        """String and boolean columns whose leading rows do not prove them of many values."""
        columns = [c for c in self.columns if self.kinds[c] in ("string", "boolean")]
        return [c for c in columns if not self.surely_more_than(c, rules.HIGH_CARDINALITY)]

    def _sizes(self) -> dict[str, int]:
        """Distinct values of the counted columns, from their kept histogram."""
        from tallyscope.plans.histogram import value_counts

        columns = self.counted_columns()
        counts = value_counts(self, columns)
        if self.by:
            counts = counts.select("column", "value").distinct()
        found = dict(counts.groupBy("column").agg(F.count(F.lit(1))).collect())
        return {c: found.get(c, 0) for c in columns}


def zoneless(instant: Column) -> Column:
    """The UTC reading of an instant as a timestamp without zone."""
    micros = F.unix_micros(instant)
    days = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    whole, rest = F.floor(micros / 86_400_000_000), F.pmod(micros, F.lit(86_400_000_000))
    seconds = (rest / 1_000_000).cast("decimal(18,6)")
    return days + F.make_dt_interval(whole.cast("int"), F.lit(0), F.lit(0), seconds)


def table(df: DataFrame | Table, by: Sequence[str] = ()) -> Table:
    if isinstance(df, Table):
        return df
    return Table(df, by)


def set_sizes(t: Table, columns: Sequence[str], bits: int) -> dict[str, int]:
    """Number of distinct non-null values per column: exact up to 2**bits, beyond that an estimate with
    a relative standard error of 2**(-bits/2), which is more than 2**bits too.

    Values count by their 64-bit hashes. One scan for all columns; what is shuffled and kept has a
    fixed size for each task and column.
    """
    if not columns:
        return {}
    hashed = [F.when(field(c).isNotNull(), F.xxhash64(field(c))) for c in columns]
    sets = [F.theta_sketch_agg(h, F.lit(bits)).alias(f"s{i}") for i, h in enumerate(hashed)]
    group = F.pmod(F.spark_partition_id(), F.lit(SET_GROUPS)).alias("tasks")
    merged = t.df.groupBy(group).agg(*sets)
    whole = merged.agg(
        *[F.coalesce(F.theta_sketch_estimate(F.theta_union_agg(f"s{i}", F.lit(bits))), F.lit(0)) for i in range(len(columns))]
    )
    return dict(zip(columns, whole.first()))


def more_distinct_than(t: Table, columns: Sequence[str], limit: float) -> dict[str, bool]:
    """Whether a column of integers or texts has more distinct non-null values than this.

    A bounded set settles it unless the number is close to the limit; only then it is counted.
    """
    margin = DEVIATIONS * 2 ** (-WIDE_SET_BITS / 2)
    result, close = {}, []
    for c, n in set_sizes(t, columns, WIDE_SET_BITS).items():
        if n <= 1 << WIDE_SET_BITS or abs(n - limit) > margin * n:
            result[c] = n > limit
        else:
            close.append(c)
    return result | {c: n > limit for c, n in exact_distinct(t, close).items()}


def exact_distinct(t: Table, columns: Sequence[str]) -> dict[str, int]:
    """Number of distinct non-null values per column, over the whole table (long texts: of their
    128-bit digests)."""
    counts = {c: 0 for c in columns}
    for names in same_type(t, columns):
        values = t.df.select(unpivoted(t, names, quoted)).where("value is not null")
        if t.kinds[names[0]] == "string":
            values = values.withColumn("value", digest(F.col("value")))
        rows = (
            values
            .select("position", "value")
            .distinct()
            .groupBy("position")
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        names_at = {t.position[c]: c for c in names}
        counts.update({names_at[r["position"]]: r["n"] for r in rows})
    return counts


def digest(value: Column) -> Column:
    """A short stand-in for a text: itself, or its 128-bit digest if it is long."""
    return F.when(F.length(value) > DIGEST_LENGTH, F.md5(value)).otherwise(F.concat(F.lit("="), value))


def same_type(t: Table, columns: Sequence[str]) -> list[list[str]]:
    """Split columns into lists that can share one value column."""
    lists: dict[str, list[str]] = {}
    for c in columns:
        kind = "bigint" if t.kinds[c] == "integer" else t.physical[c]
        lists.setdefault(kind, []).append(c)
    return list(lists.values())


def unpivoted(t: Table, columns: Sequence[str], value: Callable[[str], str]) -> Column:
    """Generator of (position, column, value) rows; ``value`` gives SQL for a column name."""
    return inlined(
        [
            {"position": t.position[c], "column": text(c), "value": value(c)}
            for c in columns
        ]
    )


def name_at(t: Table, columns: Sequence[str], position: str = "position") -> Column:
    """The column name for a position; lets aggregations group by the number alone."""
    cases = " ".join(f"WHEN {t.position[c]} THEN {text(c)}" for c in columns)
    return F.expr(f"CASE {position} {cases} END").alias("column")


def inlined(rows: Sequence[dict[str, object]]) -> Column:
    """Generator that turns one row into several; each is given as SQL per output column."""
    structs = [
        "struct(" + ", ".join(f"{v} AS {quoted(k)}" for k, v in row.items()) + ")" for row in rows
    ]
    return F.expr(f"inline(array({', '.join(structs)}))")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; key columns appear once."""
    renamed = {k: f"__right_{i}" for i, k in enumerate(keys)}
    right = right.select(*[field(c).alias(renamed.get(c, c)) for c in right.columns])
    condition = reduce(
        lambda a, b: a & b, [left[quoted(k)].eqNullSafe(right[renamed[k]]) for k in keys]
    )
    joined = left.join(right, condition, how)
    return joined.drop(*renamed.values())


# A per-group table is broadcast only when its bytes have been added up and are no more than this.
# Spark would guess from the size of its files, which says little about the rows in memory.
BROADCAST_BYTES = 32_000_000
# Otherwise its rows are repeated this often, so that one hot group is shared by as many tasks.
SALTS = 32


def with_group_values(
    t: Table, rows: DataFrame, values: DataFrame, keys: Sequence[str] | None = None
) -> DataFrame:
    """Attach a row of per-group values (array<double> columns) to every row.

    Without group keys the single row of values is read back and becomes literals, so
    the scan keeps its shape. With keys, ``values`` is materialised and counted: a small
    one is broadcast, a large one is joined on the keys plus a salt, always by sorting both sides.
    """
    keys = t.by if keys is None else list(keys)
    if not keys:
        row = values.first()
        literals = [
            F.array(*[F.lit(x).cast("double") for x in (row[c] or [])]).alias(c)
            for c in values.columns
        ]
        return rows.select("*", *literals)
    values = written(values, "group-values")
    size = F.lit(32)
    for f in values.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            size = size + 24 + 8 * F.size(field(f.name))
        elif isinstance(f.dataType, T.StringType):
            size = size + 24 + F.coalesce(F.octet_length(field(f.name)), F.lit(0))
        else:
            size = size + 16
    if (values.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        return join_on(rows, F.broadcast(values), keys)
    salted = rows.withColumn(
        "__salt", F.pmod(F.xxhash64(*[field(c) for c in rows.columns]), F.lit(SALTS)).cast("int")
    )
    repeated = values.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_on(salted, repeated.hint("merge"), [*keys, "__salt"]).drop("__salt")
