"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from zonalyx.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canon(df: pd.DataFrame) -> list:
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return ""
        if isinstance(x, str):
            return x
        if hasattr(x, "__len__"):
            return str(list(x))
        return f"{float(x) + 0.0:.9g}"

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_fold_text_whole_takes_every_document_to_its_end(spark, tmp_path):
    texts = {1: ("en", "Über " + "x " * 300 + "ÉTÉ  End"), 2: ("fr", "À la\tfin " + "é" * 500 + " –Ñ"), 3: (None, " Œuvre "), 4: ("de", ""), 5: ("es", None)}
    spark.createDataFrame([(k, t, lang) for k, (lang, t) in texts.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.folded for r in registry.queries()["r140_fold_text_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: "uber " + "x " * 300 + "ete end", 2: "a la fin " + "e" * 500 + " -n", 3: "ouvre", 4: "", 5: None}


def test_segments_reach_the_last_user(spark, tmp_path):
    spark.createDataFrame([(k, k % 300, 1.0) for k in range(600)], "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["r214_segments"](spark, str(tmp_path)).toPandas()
    assert sorted(got.segment) == list(range(300)) and got.n.sum() == 600


def test_points_on_borders_of_cells_are_in_the_cell_that_begins_there(spark, duck, tmp_path):
    balances = [3000.0, 2999.99, 2000.0, -1000.0, -999.99, 0.0, -0.01, 1000.0, 999.99, None]
    rows = [(k, balances[k % 10]) for k in [*range(40), *range(990, 1010), *range(1990, 2010)]]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.queries()["r040_point_in_polygon"](spark, str(tmp_path)).toPandas()
    sql = registry.oracle_sql()["r040_point_in_polygon"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert canon(got) == canon(duck.sql(sql).df())


def test_a_value_of_zero_has_no_proportion(spark, duck, tmp_path):
    rows = list(enumerate([0.0, -0.0, 1e-9, -5.0, 50.0, 100.0, 250.0, None]))
    spark.createDataFrame(rows, "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["r121_bounded_proportion"](spark, str(tmp_path)).toPandas()
    assert canon(got) == canon(duck.sql(registry.oracle_sql()["r121_bounded_proportion"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).df())


def test_codes_of_keys_of_more_than_four_digits(spark, duck, tmp_path):
    spark.createDataFrame([(k,) for k in (0, 7, 999, 9999, 10000, 10001, 12345, 899999)], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.queries()["r143_canonical_ids"](spark, str(tmp_path)).toPandas()
    assert canon(got) == canon(duck.sql(registry.oracle_sql()["r143_canonical_ids"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet/*.parquet'")).df())
