import pytest

import tallyscope as ts
from tests.conftest import rows


def write(tmp_path, data, name="data.csv"):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_types(spark, tmp_path):
    text = (
        "i,f,b,s,gappy,big,exp,mixed,flag\n"
        "1,1.5,True,x,1,9223372036854775807,1e3,1,true\n"
        "2,2,False,1,,1,-2.5E-1,a,\n"
        "-3,.5,TRUE,y,3,2,inf,2,FALSE\n"
    )
    found = ts.read_csv(spark, write(tmp_path, text)).df
    assert dict(found.dtypes) == {
        "i": "bigint", "f": "double", "b": "boolean", "s": "string", "gappy": "bigint",
        "big": "bigint", "exp": "double", "mixed": "string", "flag": "boolean",
    }
    assert [r["exp"] for r in found.collect()] == [1000.0, -0.25, float("inf")]
    assert [r["flag"] for r in found.collect()] == [True, None, False]


def test_java_number_suffixes_stay_text(spark, tmp_path):
    assert ts.read_csv(spark, write(tmp_path, "a\n1.0d\n2f\n")).df.dtypes == [("a", "string")]


def test_missing_tokens_and_empty_rows_and_columns(spark, tmp_path):
    tokens = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
              "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", ""]
    text = "k,v,empty\n" + "".join(f"{i},{t},\n" for i, t in enumerate(tokens)) + "NA,,null\n,,\n99,5,\n"
    found = ts.read_csv(spark, write(tmp_path, text))
    assert found.df.columns == ["k", "v"] and found.dropped_columns == ["empty"]
    assert found.df.count() == len(tokens) + 1
    assert found.df.where("v is not null").count() == 1 and dict(found.df.dtypes)["v"] == "bigint"


def test_bad_lines(spark, tmp_path):
    text = 'a,b,c\n1,2,3\n4,5\n6,7,8,9\n"x, ""y""\nz",10,11\n12\n'
    found = ts.read_csv(spark, write(tmp_path, text))
    assert found.dropped_lines == 1
    got = [(r["a"], r["b"], r["c"]) for r in found.df.collect()]
    assert got == [("1", 2, 3), ("4", 5, None), ('x, "y"\nz', 10, 11), ("12", None, None)]


def test_quoted_commas_in_short_lines_are_not_extra_fields(spark, tmp_path):
    found = ts.read_csv(spark, write(tmp_path, 'a,b,c\n"p,q,r,s",1\nt,2,3\n'))
    assert found.dropped_lines == 0 and found.df.count() == 2


def test_names(spark, tmp_path):
    text = "﻿ id , id ,,x,x,X\n1,2,3,4,5,6\n7,8,9,1,2,3\n"
    found = ts.read_csv(spark, write(tmp_path, text)).df
    # numbered before they are stripped; Spark takes "X" for "x"
    assert found.columns == ["id", "id .1", "Unnamed: 2", "x", "x.1", "X.2"]
    assert [tuple(r) for r in found.collect()] == [(1, 2, 3, 4, 5, 6), (7, 8, 9, 1, 2, 3)]


def test_latin1_fallback(spark, tmp_path):
    path = write(tmp_path, "name,n\ncafé,1\nnaïve,2\n".encode("latin-1"))
    found = ts.read_csv(spark, path)
    assert found.encoding == "ISO-8859-1"
    assert [r["name"] for r in found.df.collect()] == ["café", "naïve"]
    utf = ts.read_csv(spark, write(tmp_path, "name,n\ncafé,1\n", "utf.csv"))
    assert utf.encoding == "UTF-8" and utf.df.first()["name"] == "café"
    explicit = ts.read_csv(spark, path, encoding="ISO-8859-1")
    assert explicit.df.first()["name"] == "café"


def test_errors(spark, tmp_path):
    for text, message in (("", "empty"), ("a,b\n", "no data rows"), ("a,b\n,\nNA,\n", "only empty")):
        with pytest.raises(ts.InputError, match=message):
            ts.read_csv(spark, write(tmp_path, text, f"{len(text)}.csv"))


def test_folders_limits_and_row_index(spark, tmp_path):
    for i in range(3):
        write(tmp_path, f"a,b\n{i},x\n{i + 10},y\n", f"part{i}.csv")
    write(tmp_path, "not,a,table\n", "notes.txt")
    found = ts.read_csv(spark, str(tmp_path), row_index="row").df
    assert found.count() == 6 and found.select("row").distinct().count() == 6
    assert ts.read_csv(spark, str(tmp_path), max_rows=4).df.count() == 4
    plain = ts.read_csv(spark, str(tmp_path), multiline=False).df
    assert sorted(r["a"] for r in plain.collect()) == [0, 1, 2, 10, 11, 12]
    info = rows(ts.file_info(spark, str(tmp_path)), "filename")
    assert [r["filename"] for r in info] == ["part0.csv", "part1.csv", "part2.csv"]
    assert all(r["size_bytes"] == (tmp_path / r["filename"]).stat().st_size for r in info)


def test_row_index_keeps_the_place_of_dropped_rows(spark, tmp_path):
    found = ts.read_csv(spark, write(tmp_path, "a,b\n1,2\n,\n3,4\n"), row_index="row").df
    assert [r["row"] for r in found.collect()] == [0, 2]


def test_sinks(spark, sales, tmp_path):
    run = ts.analyze(sales, "quick")
    ts.write_results(run.tables, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "kpis")).count() == 9
    ts.write_kpis(run["kpis"], str(tmp_path / "kpis"))
    found = [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "kpis")).collect()]
    assert found[0] == ("Total Records", "20.0", "20") and found[1][1] == "Jan 2025 – Jan 2025"
    ts.write_report(run["findings"], str(tmp_path / "report"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert text.startswith("### Total Records\n**20** detected as a key metric in your data.\n")


@pytest.mark.parametrize("field", ["x" * 200_000, 'a""b,' * 40_000, "line\nend," * 30_000])
def test_very_long_quoted_fields_in_lines_marked_corrupt(spark, tmp_path, field):
    """A short line is padded and a long one dropped, whatever stands inside quotes."""
    (tmp_path / "a.csv").write_text(f'a,b,c\n1,2,3\n4,"{field}"\n5,"{field}",6,7\n')
    found = ts.read_csv(spark, str(tmp_path))
    rows = found.df.orderBy("a").collect()
    assert [r.a for r in rows] == [1, 4] and [r.c for r in rows] == [3, None]
    assert rows[1].b == field.replace('""', '"') and found.dropped_lines == 1
