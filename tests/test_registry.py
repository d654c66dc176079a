"""Every registered query outside the optional subpackage against its SQL, and never empty."""

import math
import os

import duckdb
import pytest

from folio_spark.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Too small a table for a match at this size.
MAY_BE_EMPTY = {"near_dup_pairs", "context_windows", "assoc_jaccard"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got or name in MAY_BE_EMPTY
    if name in ORACLES:
        res = db.execute(ORACLES[name])
        at = {x[0]: i for i, x in enumerate(res.description)}
        assert sorted(at) == cols
        assert got == sorted((tuple(norm(r[at[c]]) for c in cols) for r in res.fetchall()), key=str)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "score"]


def test_scan_prunes_columns(spark):
    plan = QUERIES["latest_per_source"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema:")[1]
