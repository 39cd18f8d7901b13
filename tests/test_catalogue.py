"""Every registered query of the line operators against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from sluice.functions import sniff
from sluice.operators import merge
from sluice.plans import file_queries  # noqa: F401  (registers queries)
from sluice.plans.catalogue import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[k] for k in place)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_csv_fields_of_every_line(spark, tmp_path):
    texts = ['a,b\n"x,y",z\n\nsay ""hi"", now', '"open, and,on', "", '1,"a ""q"" b",\n",",","', None]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for k, t in enumerate(texts):
        for n, line in enumerate(t.split("\n") if t is not None else [], 1):
            f = sniff.fields_of(line)
            want.append((k, n, len(f), f[0] if f else None))
    assert sorted(map(tuple, QUERIES["csv_fields"](spark, str(tmp_path)).collect())) == want
    lines = sum(r.text.count("\n") + 1 for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text is not None)
    assert QUERIES["csv_fields"](spark, DATA).count() == lines


def test_utf8_of_every_text(spark, tmp_path):
    spark.createDataFrame([(1, "ascii"), (2, "é"), (3, ""), (4, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["utf8_valid"](spark, str(tmp_path)).collect()))
    assert got == [(1, True, False), (2, True, False), (3, True, False), (4, None, None)]


def test_csv_fields_sql_on_quotes(spark, tmp_path):
    texts = ['a"b""c"d,e', '"""', '"x', '""', '""""', '"a""",b', 'x"",y', '"a","b"', ',"q"', '"a""b"",c",d']
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = [(k, 1, len(f := sniff.fields_of(t)), f[0]) for k, t in enumerate(texts)]
    assert sorted(con.sql(ORACLES["csv_fields"]).fetchall()) == want == sorted(map(tuple, QUERIES["csv_fields"](spark, str(tmp_path)).collect()))


@pytest.mark.parametrize("small", [0, 1 << 40])
def test_numbers_are_ranks_whatever_the_size(spark, small, monkeypatch):
    monkeypatch.setattr(merge, "SMALL", small)
    df = spark.range(1000).selectExpr("cast(id % 7 as long) as a", "-id as b").repartition(5)
    got = merge.numbered(df, ["a", "b"]).collect()
    want = sorted((k % 7, -k) for k in range(1000))
    assert sorted((r.seq, r.a, r.b) for r in got) == [(n, a, b) for n, (a, b) in enumerate(want, 1)]


def test_outer_joins_have_rows_without_partners(spark):
    full = QUERIES["join_full"](spark, DATA)
    assert full.where("left_no is null").count() and full.where("right_no is null").count() and full.where("left_no = right_no or left_no is not null").count()
    assert QUERIES["join_right_observed"](spark, DATA).count() and QUERIES["join_left"](spark, DATA).where("right_no is null").count()
