"""The subpackage's queries against their SQL on the whole small tables."""

import os

import duckdb
import pytest

from folio_spark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(ORACLES[name])
    at = {x[0]: i for i, x in enumerate(res.description)}
    assert sorted(at) == cols
    want = sorted((tuple(r[at[c]] for c in cols) for r in res.fetchall()), key=str)
    assert want and sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want
