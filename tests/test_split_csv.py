"""Quoted CSV files cut into small parts, against Python's reader of whole files."""

import csv
import io
import random

import pytest

from zonalyx.sources import split_csv
from zonalyx.sources import tables as src


@pytest.fixture
def small_parts(spark):
    """Parts of a few hundred bytes, so that records cross borders."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)


def table(n, seed, long=0):
    r = random.Random(seed)
    cell = lambda: r.choice(["plain", "", "with, comma", 'a "quoted" word', "two\nlines", "é–x", "a\r\nb", "\n\n", '"', "x" * r.randrange(60)])
    rows = [["id", "a b", "note"], *[[str(k), cell() or "z", cell() or "z"] for k in range(n)]]
    if long:
        rows[n // 2][2] = "line\n" * long
    return rows


def as_csv(rows, sep=",", end="\n"):
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize(("sep", "end", "encoding"), [(",", "\n", "utf-8"), (";", "\r\n", "cp1252")])
def test_records_that_cross_parts(spark, small_parts, tmp_path, sep, end, encoding):
    one, two = table(120, 1, long=400), table(40, 2)
    for name, rows in (("a", one), ("b", two)):
        (tmp_path / f"{name}.csv").write_bytes(as_csv(rows, sep, end).encode(encoding))
    assert split_csv.raw_lines(spark, str(tmp_path)).select("file", "start").distinct().count() > 10
    got = src.read_csv_probed(spark, str(tmp_path), encodings=("utf-8", "cp1252", "latin-1"))
    assert got.columns == one[0]
    assert sorted(map(list, got.collect())) == sorted(one[1:] + two[1:])


def test_open_quotes_wrong_widths_and_empty_files(spark, small_parts, tmp_path):
    (tmp_path / "x.csv").write_text('k,v\n1,a\n2\n3,b,c\n\n4,"no end\n' + "more\n" * 200)
    got = {r.k: (r.v, r.bad) for r in src.read_csv_probed(spark, str(tmp_path / "x.csv"), corrupt="bad").collect()}
    assert got["1"] == ("a", None) and got["2"][1] == "2" and got["3"][1] == "3,b,c" and got["4"][0].count("more") == 200
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        src.read_csv_probed(spark, str(tmp_path / "none.csv"))
    (tmp_path / "head.csv").write_text("a,b\n")
    assert src.read_csv_probed(spark, str(tmp_path / "head.csv")).count() == 0
    with pytest.raises(ValueError, match="reads"):
        (tmp_path / "late.csv").write_bytes(b"a,b\n" + b"1,2\n" * 500 + b"3,\xff\n")
        src.read_csv_probed(spark, str(tmp_path / "late.csv"), encodings=("utf-8",))


def test_separator_is_that_of_most_records(spark, small_parts, tmp_path):
    (tmp_path / "s.csv").write_text("a;b\n" + 'x,y,z;"1,2,3;4\n;;;"\n' * 3 + "p;q\n" * 400)
    rows = split_csv.records(split_csv.raw_lines(spark, str(tmp_path / "s.csv")), "utf-8")
    assert split_csv.separator_of(rows) == ";"
    assert src.read_csv_probed(spark, str(tmp_path / "s.csv")).where("a = 'p' and b = 'q'").count() == 400
