"""Registered similarity queries against their SQL on odd and larger tables made here."""

import duckdb
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq

from folio_spark.registry import ORACLES, QUERIES


def both(spark, folder, name, **tables):
    """Rows of the query and of its SQL over the given Arrow tables."""
    con = duckdb.connect()
    for t, data in tables.items():
        pq.write_table(data, f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    res = con.execute(ORACLES[name])
    at = [[x[0] for x in res.description].index(c) for c in df.columns]
    want = [tuple(r[i] for i in at) for r in res.fetchall()]
    return sorted(map(tuple, df.collect()), key=str), sorted(want, key=str)


def test_best_duplicate_of_empty_and_null_texts(spark, tmp_path):
    texts = ["", "", None, "Two words", " two words", None, " \n", "", "alone", "alone"]
    docs = pa.table({"doc_id": pa.array([9, 2, 5, 8, 13, 4, 30, None, None, 3], pa.int64()), "text": texts, "n_chars": pa.array([0] * 10, pa.int64())})
    got, want = both(spark, tmp_path, "best_duplicate", documents=docs)
    assert got == want and len(got) == 4
    empty = docs.filter(pa.compute.equal(docs["text"], ""))
    got, want = both(spark, tmp_path, "best_duplicate", documents=empty)
    assert got == want and len(got) == 1
