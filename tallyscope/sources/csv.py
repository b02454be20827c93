"""CSV source: header clean-up, bad lines, encodings, missing tokens, type inference."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.operators.analyze import InputError
from tallyscope.plans.table import field

# Tokens that mean "missing", besides the empty field.
MISSING_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
INTEGER_TEXT = r"^\\s*[+-]?[0-9]+\\s*$"
NUMBER_TEXT = (
    r"^\\s*[+-]?([0-9]+\\.?[0-9]*([eE][+-]?[0-9]+)?|\\.[0-9]+([eE][+-]?[0-9]+)?"
    r"|(?i:inf|infinity))\\s*$"
)
CORRUPT = "__corrupt"


@dataclass
class CsvTable:
    """The cleaned table, and what was done to get it."""

    df: DataFrame
    encoding: str
    dropped_lines: int
    dropped_columns: list[str]


def clean_names(header: list[str | None]) -> list[str]:
    """Blank names become "Unnamed: i", repeated ones get a number, all are stripped."""
    seen: dict[str, int] = {}
    names = []
    for i, raw in enumerate(header):
        name = f"Unnamed: {i}" if raw is None or raw == "" else raw
        if name in seen:
            seen[name] += 1
            name = f"{name}.{seen[name]}"
        seen.setdefault(name, 0)
        names.append(name)
    return unique([n.strip() for n in names])


def unique(names: list[str]) -> list[str]:
    """Stripping can make names equal; Spark needs them different."""
    taken: set[str] = set()
    result = []
    for name in names:
        candidate, i = name, 0
        while candidate.lower() in taken:
            i += 1
            candidate = f"{name}.{i}"
        taken.add(candidate.lower())
        result.append(candidate)
    return result


def _reader(spark: SparkSession, encoding: str, multiline: bool, glob: str):
    return (
        spark.read.option("encoding", encoding)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("pathGlobFilter", glob)
    )


def _raw(
    spark: SparkSession, path: str, names: int, encoding: str, multiline: bool, glob: str
) -> DataFrame:
    schema = ", ".join([*(f"c{i} string" for i in range(names)), f"{CORRUPT} string"])
    return (
        _reader(spark, encoding, multiline, glob)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .schema(schema)
        .csv(path)
    )


def too_long(width: int) -> Column:
    """Lines with more fields than the header. Spark marks short lines as corrupt too, so
    the separators outside quotes are counted, on marked lines only. The pattern gives nothing
    back, so that it needs no stack however long a field is."""
    bare = F.regexp_replace(F.col(CORRUPT), '"[^"]*+(?:""[^"]*+)*+"', "")
    separators = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
    return F.coalesce(separators + 1 > width, F.lit(False))


def present(name: str) -> Column:
    value = field(name)
    return F.when(~value.isin("", *MISSING_TOKENS), value)


def read_csv(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    max_rows: int | None = None,
    multiline: bool | None = None,
    path_glob: str = "*.csv",
    row_index: str | None = None,
) -> CsvTable:
    """Read CSV files with one header into a cleaned, typed table.

    Lines with too many fields are dropped and counted, short ones padded. Types are
    decided on all rows in one aggregation over the text. Without ``encoding`` the files
    are taken as UTF-8, or as Latin-1 if their bytes are not valid UTF-8. Files are split among
    tasks unless a line with an open quote shows that a field contains a line break;
    ``multiline`` settles that without a look. All files must have the same header.
    ``row_index`` adds a column that increases with the position of each row.
    """
    first = _reader(spark, encoding or "UTF-8", True, path_glob).csv(path).take(1)
    if not first:
        raise InputError("the file is empty")
    _same_headers(spark, path, path_glob)
    used = encoding or ("UTF-8" if _valid_utf8(spark, path, path_glob) else "ISO-8859-1")
    if multiline is None:
        multiline = _has_open_quotes(spark, path, path_glob)
    names = clean_names(_header(spark, path, used, path_glob))
    lines, facts = _facts(spark, path, names, used, multiline, path_glob, max_rows)
    if facts["rows"] == 0:
        raise InputError("the file contains no data rows")

    kept = [i for i in range(len(names)) if facts[f"n{i}"]]
    if not kept:
        raise InputError("the file contains only empty rows or columns")
    any_value = F.coalesce(*[F.col(f"c{i}") for i in kept]).isNotNull()
    if row_index is not None:
        lines = lines.withColumn("__index", F.monotonically_increasing_id())
    typed = [_typed(f"c{i}", facts, i).alias(names[i]) for i in kept]
    if row_index is not None:
        typed.append(F.col("__index").alias(row_index))
    return CsvTable(
        df=lines.where(any_value).select(*typed),
        encoding=used,
        dropped_lines=facts["dropped"],
        dropped_columns=[n for i, n in enumerate(names) if i not in kept],
    )


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Lines as their bytes; the text source does not check them."""
    return spark.read.option("pathGlobFilter", glob).text(path)


def _valid_utf8(spark: SparkSession, path: str, glob: str) -> bool:
    """Stops at the first line that is not."""
    return _lines(spark, path, glob).where(~F.is_valid_utf8("value")).isEmpty()


def _has_open_quotes(spark: SparkSession, path: str, glob: str) -> bool:
    """Whether some line has an odd number of quotes; stops at the first one."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not _lines(spark, path, glob).where(quotes % 2 == 1).isEmpty()


def _same_headers(spark: SparkSession, path: str, glob: str) -> None:
    """Columns are read by place, so a file with another header line would be misread."""
    files = _lines(spark, path, glob).inputFiles()
    if len(files) < 2:
        return

    def first(file: str) -> str | None:
        line = spark.read.text(file).first()
        return None if line is None else line.value.lstrip("\ufeff").rstrip("\r")

    with ThreadPoolExecutor(max_workers=16) as pool:
        headers = dict(zip(files, pool.map(first, files)))
    found = {h for h in headers.values() if h is not None}
    if len(found) > 1:
        other = next(f for f, h in headers.items() if h not in (None, headers[files[0]]))
        raise InputError(f"{other} has another header than {files[0]}")


def _header(spark: SparkSession, path: str, encoding: str, glob: str) -> list[str | None]:
    row = (
        _reader(spark, encoding, True, glob)
        .option("header", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
        .first()
    )
    header = list(row)
    if header and header[0] is not None:
        header[0] = header[0].lstrip("﻿")
    return header


def _facts(spark, path, names, encoding, multiline, glob, max_rows):
    """The lines as text columns, and all that typing needs to know about them."""
    raw = _raw(spark, path, len(names), encoding, multiline, glob)
    marked = raw.withColumn("__long", too_long(len(names)))
    columns = [f"c{i}" for i in range(len(names))]
    if max_rows is not None:
        marked = marked.where("not __long").limit(max_rows)
    texts = marked.select("__long", *[present(c).alias(c) for c in columns])
    tokens = ", ".join(f"'{t}'" for t in TRUE_TOKENS + FALSE_TOKENS)
    wanted = [F.expr("count_if(not __long) AS rows"), F.expr("count_if(__long) AS dropped")]
    for i, name in enumerate(columns):
        c = f"IF(__long, NULL, {name})"
        whole = f"{c} RLIKE '{INTEGER_TEXT}' AND try_cast({c} AS BIGINT) IS NOT NULL"
        wanted += [
            F.expr(f"count({c}) AS n{i}"),
            F.expr(f"count_if({whole}) AS int{i}"),
            F.expr(f"count_if({c} RLIKE '{NUMBER_TEXT}') AS num{i}"),
            F.expr(f"count_if({c} IN ({tokens})) AS bool{i}"),
        ]
    facts = texts.agg(*wanted).first().asDict()
    return texts.where("not __long").drop("__long"), facts


def _typed(column: str, facts: dict, i: int) -> Column:
    n = facts[f"n{i}"]
    value = F.col(column)
    if facts[f"int{i}"] == n:
        return F.trim(value).try_cast("bigint")
    if facts[f"num{i}"] == n:
        return F.trim(value).try_cast("double")
    if facts[f"bool{i}"] == n:
        return F.when(value.isNotNull(), value.isin(*TRUE_TOKENS))
    return value


def file_info(spark: SparkSession, path: str, path_glob: str = "*.csv") -> DataFrame:
    """(filename, size_bytes, size_mb) per file; no file is opened."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", path_glob)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size_bytes"),
        F.round(F.col("length") / 1024 / 1024, 2).alias("size_mb"),
    )
