"""Time analysis: date column, grain, period series, trends, seasonality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope import rules
from tallyscope.functions.probability import t_two_sided
from tallyscope.plans.gaps import gaps
from tallyscope.plans.shared import written
from tallyscope.plans.table import (
    Fact,
    Table,
    field,
    inlined,
    join_on,
    quoted,
    table,
    text,
    with_group_values,
)

GRAINS = ("daily", "weekly", "monthly", "quarterly", "yearly")
# Largest median gap, in days, of each grain but the last (fixed values).
GRAIN_DAYS = (("daily", 1.5), ("weekly", 8.0), ("monthly", 35.0), ("quarterly", 100.0))
DAY_MICROS = 86_400_000_000
MIN_DATES = 2
SEASON_DATES = 12
SEASON_CV = 20.0


def date_column(df: DataFrame | Table) -> str | None:
    """First date or timestamp column, or string column that reads as dates.

    A string column counts if more than 80 % of all its rows are dates in the format of
    its first value.
    """
    t = table(df)
    if "date_column" in t.__dict__:
        return t.__dict__["date_column"]
    found = None
    candidates = []
    for c in t.columns:
        if t.kinds[c] == "temporal":
            found = c
            break
        if t.kinds[c] == "string" and t.date_formats[c] is not None:
            candidates.append(c)
    if candidates:
        wanted = {"rows": Fact(F.count(F.lit(1)), 1)}
        for c in candidates:
            wanted |= date_facts(t, c)
        found_all = (t.df.agg(*[f.value.alias(n) for n, f in wanted.items()]) if t.by else t.facts(wanted)).first()
        rows = found_all["rows"]
        readable = [c for c in candidates if rows and found_all[f"dates_{t.position[c]}"] / rows > rules.DATE_SHARE]
        found = readable[0] if readable else found
    t.__dict__["date_column"] = found
    return found


def date_facts(t: Table, column: str) -> dict[str, Fact]:
    """How many dates a column has, the first and the last."""
    i, moment = t.position[column], t.moment(column)
    return {
        f"dates_{i}": Fact(F.count(moment), 1),
        f"first_{i}": Fact(F.min(moment), 1),
        f"last_{i}": Fact(F.max(moment), 1),
    }


def declared(t: Table) -> dict[str, Fact]:
    dates = [c for c in t.columns if t.kinds[c] == "temporal" or t.kinds[c] == "string" and t.date_formats[c] is not None]
    return {name: f for c in dates for name, f in date_facts(t, c).items()}


def micros(moment: Column) -> Column:
    """Zoneless timestamp as microseconds; differences need no time zone."""
    days = F.unix_date(F.to_date(moment)).cast("bigint")
    seconds = days * 86400 + F.hour(moment) * 3600 + F.minute(moment) * 60
    fraction = F.extract(F.lit("SECOND"), moment) * 1_000_000
    return seconds * 1_000_000 + fraction.cast("bigint")


def date_stats(t: Table, date_col: str) -> DataFrame:
    i = t.position[date_col]
    found = t.facts(date_facts(t, date_col))
    renamed = found.select(
        *t.keys, F.col(f"dates_{i}").alias("n"), F.col(f"first_{i}").alias("first"), F.col(f"last_{i}").alias("last")
    )
    return renamed.where(F.col("n") >= MIN_DATES)


def grain_label(days: Column) -> Column:
    label = F.lit(GRAINS[-1])
    for name, limit in reversed(GRAIN_DAYS):
        label = F.when(days <= limit, name).otherwise(label)
    return label


def time_grain(
    df: DataFrame | Table, date_col: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(keys, n, first, last, grain) from the median gap between sorted dates.

    Fewer than span/1.5 gaps can be longer than 1.5 days. Where that is less than half of
    all gaps the median must be daily, so crowded groups, however large, are never ordered.
    The others are ordered in ranges (see ``plans/gaps.py``), whatever their span.
    """
    t = table(df, by)
    date_col = date_col or date_column(t)
    stats = date_stats(t, date_col).withColumn(
        "crowded",
        2 * (micros(F.col("last")) - micros(F.col("first"))) / (1.5 * DAY_MICROS)
        <= F.col("n") - 3,
    )
    stats = written(stats, "grain")
    left = stats.where("NOT crowded").select(*t.keys, F.array(F.lit(1.0)).alias("__open"))
    if left.isEmpty():
        return stats.select(*t.keys, "n", "first", "last", F.lit(GRAINS[0]).alias("grain"))
    rows = t.df.select(*t.keys, micros(t.moment(date_col)).alias("__at")).where("__at IS NOT NULL")
    if t.by and not stats.where("crowded").isEmpty():
        rows = with_group_values(t, rows, left).drop("__open")
    medians = median_grain(gaps(rows, t.by, "__at"), t.by)
    if t.by:
        joined = join_on(stats, medians, t.by, "left")
    else:
        joined = stats.withColumn("__grain", F.lit(medians.first()["__grain"]))
    grain = F.when(F.col("crowded"), GRAINS[0]).otherwise(F.col("__grain"))
    return joined.select(*t.keys, "n", "first", "last", grain.alias("grain"))


def median_grain(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """(keys, __grain) of the median of gaps (in microseconds) that occur ``n`` times.

    Counts of gaps per grain tell in which the middle ones lie. If these differ, the median is half
    way from the largest gap of the one to the least of the other, so nothing needs sorting.
    """
    days = F.col("gap") / DAY_MICROS
    label = grain_label(days)
    facts = []
    for i, name in enumerate(GRAINS):
        own = label == name
        facts += [
            F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias(f"n{i}"),
            F.min(F.when(own, days)).alias(f"least{i}"),
            F.max(F.when(own, days)).alias(f"most{i}"),
        ]
    counted = found.groupBy(*[field(k) for k in by]).agg(*facts)
    upto = [" + ".join(f"n{j}" for j in range(i + 1)) for i in range(len(GRAINS))]

    def at(rank: str, values: Sequence[str]) -> str:
        cases = " ".join(f"WHEN {rank} < {u} THEN {v}" for u, v in zip(upto, values))
        return f"CASE {cases} END"

    low, high = f"({upto[-1]} - 1) DIV 2", f"({upto[-1]}) DIV 2"
    places = [str(i) for i in range(len(GRAINS))]
    # Within one grain any of its gaps gives the label.
    same = f"{at(low, places)} = {at(high, places)}"
    most, least = (at(r, [f"{name}{i}" for i in places]) for r, name in ((low, "most"), (high, "least")))
    median = F.expr(f"CASE WHEN {same} THEN {most} ELSE ({most} + {least}) / 2 END")
    return counted.select(*[field(k) for k in by], grain_label(median).alias("__grain"))


def period_start(day: Column, grain: Column) -> Column:
    return (
        F.when(grain == "daily", day)
        .when(grain == "weekly", F.trunc(day, "week"))
        .when(grain == "quarterly", F.trunc(day, "quarter"))
        .when(grain == "yearly", F.trunc(day, "year"))
        .otherwise(F.trunc(day, "month"))
    )


def period_end(start: Column, grain: Column) -> Column:
    """Label of a period: the day itself, the Sunday, or the last day."""
    return (
        F.when(grain == "daily", start)
        .when(grain == "weekly", F.date_add(start, 6))
        .when(grain == "quarterly", F.last_day(F.add_months(start, 2)))
        .when(grain == "yearly", F.make_date(F.year(start), F.lit(12), F.lit(31)))
        .otherwise(F.last_day(start))
    )


def period_step(grain: Column) -> Column:
    months = (
        F.when(grain.isin("daily", "weekly"), 0)
        .when(grain == "quarterly", 3)
        .when(grain == "yearly", 12)
        .otherwise(1)
    )
    days = F.when(grain == "daily", 1).when(grain == "weekly", 7).otherwise(0)
    return F.make_interval(months=months, days=days)


def period_number(start: Column, grain: Column) -> Column:
    """A number of the period that starts on a day; neighbouring periods differ by one."""
    months = F.year(start) * 12 + F.month(start) - 1
    return (
        F.when(grain == "daily", F.unix_date(start))
        .when(grain == "weekly", F.floor((F.unix_date(start) - 4) / 7))
        .when(grain == "quarterly", F.floor(months / 3))
        .when(grain == "yearly", F.year(start))
        .otherwise(months)
        .cast("bigint")
    )


def daily_sums(t: Table, date_col: str, metrics: Sequence[str]) -> DataFrame:
    """(keys, __day, s0, n0, ...): sum and number of each metric's values per day."""

    def summed() -> DataFrame:
        sums = []
        for i, c in enumerate(map(quoted, metrics)):
            sums += [F.expr(f"sum(CAST({c} AS DOUBLE)) AS s{i}"), F.expr(f"count({c}) AS n{i}")]
        rows = t.df.withColumn("__day", F.to_date(t.moment(date_col))).where("__day is not null")
        return rows.groupBy(*t.keys, "__day").agg(*sums)

    return t.kept(f"daily {date_col} {list(metrics)}", summed) if t.keep else summed()


def period_sums(
    df: DataFrame | Table,
    date_col: str | None = None,
    metrics: Sequence[str] | None = None,
    grain: str | DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """(keys, __grain, start, position, metric, value, rows): sums of the periods that have values.

    ``grain`` is one of the grain names, the result of ``time_grain``, or None to detect
    it. All metrics are summed in one aggregation.
    """
    t = table(df, by)
    date_col = date_col or date_column(t)
    metrics = list(metrics or t.numeric[: rules.TREND_METRICS])
    # What is joined, summed again or read by several is then days, not rows.
    daily = daily_sums(t, date_col, metrics)
    if isinstance(grain, str):
        daily = daily.withColumn("__grain", F.lit(grain))
    else:
        grains = grain if grain is not None else time_grain(t, date_col)
        if t.by:
            daily = join_on(daily, grains.select(*t.keys, F.col("grain").alias("__grain")), t.by)
        else:
            found = grains.first()
            daily = daily.withColumn("__grain", F.lit(found["grain"] if found else "monthly"))
    again = []
    for i in range(len(metrics)):
        again += [F.sum(f"s{i}").alias(f"s{i}"), F.sum(f"n{i}").alias(f"n{i}")]
    start = period_start(F.col("__day"), F.col("__grain")).alias("start")
    periods = daily.groupBy(*t.keys, "__grain", start).agg(*again)
    values = inlined(
        [
            {"position": t.position[c], "metric": text(c), "value": f"s{i}", "rows": f"n{i}"}
            for i, c in enumerate(metrics)
        ]
    )
    return periods.select(*t.keys, "__grain", "start", values).where("rows > 0")


def period_series(
    df: DataFrame | Table,
    date_col: str | None = None,
    metrics: Sequence[str] | None = None,
    grain: str | DataFrame | None = None,
    by: Sequence[str] = (),
    sums: DataFrame | None = None,
) -> DataFrame:
    """(keys, metric, periods, x, period, value): sums per calendar period, empty ones 0.

    Arguments as in ``period_sums``, whose result ``sums`` may be. The calendar holds one row per
    period.
    """
    t = table(df, by)
    long = period_sums(t, date_col, metrics, grain) if sums is None else sums
    group = [*t.by, "position", "metric", "__grain"]
    ends = long.groupBy(*[field(c) for c in group]).agg(
        F.min("start").alias("from"), F.max("start").alias("to"), F.sum("rows").alias("rows")
    )
    starts = F.sequence("from", "to", period_step(F.col("__grain")))
    calendar = (
        ends.where(F.col("rows") >= MIN_DATES)
        .withColumn("starts", starts)
        .select(
            *[field(c) for c in group],
            F.size("starts").alias("periods"),
            F.posexplode("starts").alias("x", "start"),
        )
    )
    filled = join_on(calendar, long.drop("rows"), [*group, "start"], "left")
    return filled.select(
        *t.keys,
        "position",
        "metric",
        "periods",
        "x",
        period_end(F.col("start"), F.col("__grain")).alias("period"),
        F.coalesce("value", F.lit(0.0)).alias("value"),
    )


def trends(
    df: DataFrame | Table,
    by: Sequence[str] = (),
    date_col: str | None = None,
    metrics: Sequence[str] | None = None,
    grain: str | DataFrame | None = None,
    sums: DataFrame | None = None,
) -> DataFrame:
    """Least-squares trend and latest period-over-period change per metric.

    Empty periods count as zero, but no row is made for them: with k periods, n of them not empty, of
    numbers x and sums y, they add nothing to sums of products with y, and k alone gives all sums of
    x. ``sums`` may be an existing ``period_sums`` result.
    """
    t = table(df, by)
    sums = written(period_sums(t, date_col, metrics, grain), "sums") if sums is None else sums
    group = [*t.by, "position", "metric", "__grain"]
    number = period_number(F.col("start"), F.col("__grain"))
    # Counted from the earliest one: products of small numbers are exact more often.
    numbered = sums.withColumn("x", number - F.lit(sums.agg(F.min(number)).first()[0])).withColumnRenamed("value", "y")
    x, y = F.col("x"), F.col("y")
    # The period before the last one is the latest of the other parity, or empty.
    parity = []
    for side in (0, 1):
        own = F.when(F.pmod(x, F.lit(2)) == side, x)
        parity += [F.max(own).alias(f"x{side}"), F.max_by(y, own).alias(f"y{side}")]
    fitted = numbered.groupBy(*[field(c) for c in group]).agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("own_mean"),
        F.min(y).alias("least"),
        F.max(y).alias("most"),
        F.min(x).alias("from"),
        F.max(x).alias("to"),
        F.max("start").alias("last"),
        F.avg(x).alias("x_mean"),
        F.covar_pop(x, y).alias("covariance"),
        F.var_pop(y).alias("variance"),
        *parity,
    )
    n, k, own = F.col("n"), F.col("k"), F.col("own_mean")
    centre = (k - 1) / 2
    back = F.col("to") - 1
    before = F.add_months(F.col("last"), -F.when(F.col("__grain") == "quarterly", 3).when(F.col("__grain") == "yearly", 12).otherwise(1))
    before = (
        F.when(F.col("__grain") == "daily", F.date_sub("last", 1))
        .when(F.col("__grain") == "weekly", F.date_sub("last", 7))
        .otherwise(before)
    )
    fitted = (
        fitted.where(F.col("rows") >= MIN_DATES)
        .withColumn("k", F.col("to") - F.col("from") + 1)
        .where(k >= MIN_DATES)
        .withColumn("mean", n * own / k)
        .withColumn("sxy", n * (F.col("covariance") + (F.col("x_mean") - F.col("from") - centre) * own))
        .withColumn("sxx", k.cast("double") * (k.cast("double") * k - 1) / 12)
        .withColumn(
            "syy",
            n * (F.col("variance") + (own - F.col("mean")) * (own - F.col("mean"))) + (k - n) * F.col("mean") * F.col("mean"),
        )
        .withColumn("flat", F.when(n == k, F.col("least") == F.col("most")).otherwise((F.col("least") == 0) & (F.col("most") == 0)))
        .withColumn("slope", F.col("sxy") / F.col("sxx"))
        .withColumn("r2", F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")))
        .withColumn("current_period", period_end(F.col("last"), F.col("__grain")))
        .withColumn("previous_period", period_end(before, F.col("__grain")))
        .withColumn("current_value", F.when(F.col("x0") == F.col("to"), F.col("y0")).otherwise(F.col("y1")))
        .withColumn(
            "previous_value",
            F.when(F.col("x0") == back, F.col("y0")).when(F.col("x1") == back, F.col("y1")).otherwise(0.0),
        )
    )
    k = F.col("k")
    short = k < 3
    r2 = F.when(F.col("flat"), 0.0).otherwise(F.least(F.col("r2"), F.lit(1.0)))
    t_value = F.when(
        r2 < 1, F.signum("slope") * F.sqrt(r2 * (k - 2) / F.when(r2 < 1, 1 - r2))
    ).otherwise(F.signum("slope") * float("inf"))
    p = F.when(short | F.col("flat"), 1.0).otherwise(t_two_sided("t_value", "df"))
    slope = F.when(short | F.col("flat"), 0.0).otherwise(F.col("slope"))
    current, previous = F.col("current_value"), F.col("previous_value")
    return (
        fitted.withColumn("t_value", t_value)
        .withColumn("df", F.greatest(k - 2, F.lit(1)).cast("double"))
        .withColumn("slope", slope)
        .withColumn("p_value", p)
        .select(
            *t.keys,
            "position",
            "metric",
            F.lit("sum").alias("aggregation"),
            k.alias("periods"),
            F.when(F.col("p_value") > 0.05, "stable")
            .when(F.col("slope") > 0, "increasing")
            .otherwise("decreasing")
            .alias("direction"),
            "slope",
            F.coalesce(F.try_divide(F.col("slope"), F.col("mean")) * 100, F.lit(0.0)).alias(
                "slope_pct"
            ),
            "p_value",
            F.col("current_period").cast("string").alias("current_period"),
            F.col("previous_period").cast("string").alias("previous_period"),
            "current_value",
            "previous_value",
            F.coalesce(F.try_divide(current - previous, previous) * 100, F.lit(0.0)).alias(
                "change_pct"
            ),
        )
    )


def seasonality(
    df: DataFrame | Table,
    by: Sequence[str] = (),
    date_col: str | None = None,
    metric: str | None = None,
    daily: tuple[DataFrame, int] | None = None,
) -> DataFrame:
    """(keys, months, cv, peak_month) of the mean per calendar month of one metric.

    ``daily`` may be a ``daily_sums`` result and the metric's place in it.
    """
    t = table(df, by)
    date_col = date_col or date_column(t)
    metric = metric or (t.numeric[0] if t.numeric else None)
    value = field(metric).cast("double") if metric else F.lit(None).cast("double")
    if daily is not None:
        sums, i = daily
        monthly = sums.where(f"n{i} > 0").groupBy(*t.keys, F.month("__day").alias("month"))
        monthly = monthly.agg((F.sum(f"s{i}") / F.sum(f"n{i}")).alias("mean"))
    else:
        rows = t.df.select(*t.keys, F.month(t.moment(date_col)).alias("month"), value.alias("value"))
        rows = rows.where("month is not null and value is not null")
        monthly = rows.groupBy(*t.keys, "month").agg(F.avg("value").alias("mean"))
    names = F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()])
    best = F.max(F.struct(F.col("mean"), (-F.col("month")).alias("early")))
    return (
        monthly.groupBy(*t.keys)
        .agg(
            F.count(F.lit(1)).alias("months"),
            F.stddev_samp("mean").alias("sd"),
            F.avg("mean").alias("centre"),
            best.alias("best"),
        )
        .select(
            *t.keys,
            "months",
            (F.try_divide("sd", "centre") * 100).alias("cv"),
            F.element_at(names, -F.col("best.early")).alias("peak_month"),
        )
    )


def time_profile(
    df: DataFrame | Table,
    by: Sequence[str] = (),
    date_col: str | None = None,
    grain: DataFrame | None = None,
    daily: tuple[DataFrame, int] | None = None,
) -> DataFrame | None:
    """Grain, range and seasonality of the date column; None without a date column.

    ``daily`` is as in ``seasonality``.
    """
    t = table(df, by)
    date_col = date_col or date_column(t)
    if date_col is None:
        return None
    grains = grain if grain is not None else time_grain(t, date_col)
    season = seasonality(t, date_col=date_col, daily=daily)
    if t.by:
        joined = join_on(grains, season, t.by, "left")
    else:
        one = season.first()
        joined = grains.withColumns(
            {
                "cv": F.lit(one["cv"] if one else None).cast("double"),
                "peak_month": F.lit(one["peak_month"] if one else None).cast("string"),
            }
        )
    found = (
        F.col("grain").isin("daily", "weekly", "monthly")
        & (F.col("n") >= SEASON_DATES)
        & F.coalesce(F.col("cv") > SEASON_CV, F.lit(False))
    )
    return joined.select(
        *t.keys,
        F.lit(date_col).alias("date_column"),
        F.col("grain").alias("detected_grain"),
        F.to_date("first").alias("start"),
        F.to_date("last").alias("end"),
        F.floor((micros(F.col("last")) - micros(F.col("first"))) / DAY_MICROS)
        .cast("int")
        .alias("span_days"),
        found.alias("seasonality_detected"),
        F.when(found, F.concat("peak_month", F.lit(" typically highest"))).alias("pattern"),
        F.when(found, F.col("cv")).otherwise(0.0).alias("cv"),
    )
