"""Every point-cloud query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    return float("%.9g" % value) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    result = duck.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in df.columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert Q.queries()[name](spark, SF).limit(5).count() > 0


def test_eigenvectors_of_equal_eigenvalues(spark, tmp_path):
    # a slab of a lattice, whose inner points spread alike along y and z, and a line far away, which has one direction only
    at = "SELECT x * 0.05 AS x, y * 0.05 AS y, z * 0.05 AS z FROM range(3) a(x), range(14) b(y), range(14) c(z) UNION ALL SELECT 9 + t * 0.05, 9 + t * 0.1, 9 + t * 0.05 FROM range(20) d(t)"
    con = duckdb.connect()
    con.execute(f"CREATE TABLE embeddings AS SELECT row_number() OVER (ORDER BY x, y, z) AS vec_id, [x, y, z]::DOUBLE[] AS embedding, 0 AS label FROM ({at})")
    con.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet'")
    df = Q.queries()["eigenvector_residuals"](spark, str(tmp_path))
    want = con.execute(Q.oracle_sql()["eigenvector_residuals"]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and sum(r[1] for r in want) == 588 + 18  # the ends of the line have one neighbour


@pytest.mark.parametrize("wrong", ["0.0", "2 * {c}", "-{c}"])
def test_residuals_tell_wrong_eigenvectors(spark, monkeypatch, wrong):
    right, at = Q.G.with_eigenvectors, {"0.0": "xyz", "2 * {c}": "xyz", "-{c}": "z"}[wrong]
    monkeypatch.setattr(Q.G, "with_eigenvectors", lambda df, **how: right(df, **how).withColumns({f"v1{c}": F.expr(wrong.format(c=f"v1{c}")) for c in at}))
    row = Q.queries()["eigenvector_residuals"](spark, SF).agg(F.count_if(F.col("defined")), F.count_if(F.col("residual1") > 0.001)).first()
    assert row[1] > 0.9 * row[0] > 0
