"""The stored keyword index against scoring every document, with appends, odd rows and pruning."""

import math
import random
from collections import Counter

import regex
from pyspark.sql import functions as F

from folio_spark.operators import inverted
from folio_spark.operators import retrieval as rt


def brute(texts, query, k):
    docs = [(i, Counter(regex.findall(r"[\p{L}\p{N}_]{2,}", (t or "").lower()))) for i, t in texts]
    n, avg = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs) or 1.0
    want = Counter(regex.findall(r"[\p{L}\p{N}_]{2,}", query.lower()))
    out = []
    for i, c in docs:
        score = 0.0
        for t, times in want.items():
            df = sum(t in d for _, d in docs)
            f = c[t]
            score += times * math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg))
        if score > 0:
            out.append((round(score, 9), i))
    return sorted(out, key=lambda x: (-x[0], x[1]))[:k]


def hits(found):
    return sorted(((round(r["score"], 9), r["id"]) for r in found.hits.collect()), key=lambda x: (-x[0], x[1]))


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma_1", "x", "über", "delta", "the"]
    return [(i, " ".join(rng.choices(words, [1, 1, 1, 3, 1, 0.2, 9], k=rng.randint(0, 30)))) for i in range(n)]


def test_search_equals_scoring_everything(spark, tmp_path):
    texts = corpus(150) + [(7, "alpha alpha"), (7, "alpha alpha"), (200, None), (201, ""), (202, "delta " * 5000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("term", F.lit("clash")).withColumn("row", F.lit(1)).repartition(3)
    inverted.append(docs, f"{tmp_path}/a", block=8)
    for query in ("alpha", "alpha beta delta", "the the über", "the", "nothing here", "", "x"):
        for k in (1, 10, None):
            assert hits(inverted.search(spark, f"{tmp_path}/a", query, k, first=2)) == brute(texts, query, k), (query, k)


def test_appends_are_one_corpus(spark, tmp_path):
    a, b = corpus(60), [(1000 + i, t) for i, t in corpus(40, 2)]
    for part in (a, b, []):
        inverted.append(spark.createDataFrame(part, "doc_id long, text string"), f"{tmp_path}/i", block=4)
    assert hits(inverted.search(spark, f"{tmp_path}/i", "alpha delta the", 12)) == brute(a + b, "alpha delta the", 12)


def test_a_failed_append_is_not_read(spark, tmp_path):
    texts = corpus(30)
    inverted.append(spark.createDataFrame(texts, "doc_id long, text string"), f"{tmp_path}/i")
    left = spark.read.parquet(f"{tmp_path}/i/postings").withColumn("segment", F.lit("lost"))
    left.write.mode("append").partitionBy("bucket").parquet(f"{tmp_path}/copy")
    spark.read.parquet(f"{tmp_path}/copy").write.mode("append").partitionBy("bucket").parquet(f"{tmp_path}/i/postings")
    assert hits(inverted.search(spark, f"{tmp_path}/i", "alpha the", 5)) == brute(texts, "alpha the", 5)


def test_blocks_that_cannot_reach_the_best_are_skipped(spark, tmp_path):
    texts = [(i, "alpha " + "filler " * 40) for i in range(400)] + [(1000 + i, "alpha " * 20) for i in range(16)]
    inverted.append(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), f"{tmp_path}/i", block=16)
    found = inverted.search(spark, f"{tmp_path}/i", "alpha", 10, first=1)
    assert hits(found) == brute(texts, "alpha", 10)
    assert found.blocks == 26 and found.scored_blocks <= 2 and found.scored_postings <= 32 < found.postings == 416


def test_only_files_of_the_terms_are_read(spark, tmp_path):
    inverted.append(spark.createDataFrame(corpus(60), "doc_id long, text string"), f"{tmp_path}/i")
    plan = inverted.search(spark, f"{tmp_path}/i", "alpha", None).hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "[bucket") or "bucket" in plan.split("PartitionFilters")[1][:120]
    assert "term" in plan.split("PushedFilters")[1][:120]


def test_index_of_a_table_follows_its_files(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.createDataFrame(corpus(20), "doc_id long, text string").coalesce(1).write.parquet(path)
    first = inverted.index_of(spark.read.parquet(path))
    assert inverted.index_of(spark.read.parquet(path)) == first
    spark.createDataFrame([(99, "alpha zeta")], "doc_id long, text string").write.mode("append").parquet(path)
    second = inverted.index_of(spark.read.parquet(path))
    assert second != first and hits(inverted.search(spark, second, "zeta"))[0][1] == 99


def test_empty_index(spark, tmp_path):
    inverted.append(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/i")
    assert hits(inverted.search(spark, f"{tmp_path}/i", "alpha", 3)) == []


def test_same_as_the_scan(spark, tmp_path):
    docs = spark.createDataFrame(corpus(80), "doc_id long, text string")
    inverted.append(docs, f"{tmp_path}/i")
    want = sorted((round(r["score"], 9), r["doc_id"]) for r in rt.bm25(docs, "beta delta", 9).collect())
    assert sorted(hits(inverted.search(spark, f"{tmp_path}/i", "beta delta", 9))) == want


def test_files_of_a_bucket_grow_with_the_table():
    assert [inverted.files_for(n) for n in (0, 1 << 20, 1 << 28, (1 << 28) + 1, 6 << 30)] == [1, 1, 1, 2, 24]


def test_blocks_are_built_in_their_task_over_any_batches(spark, tmp_path):
    texts = corpus(60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        inverted.append(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), f"{tmp_path}/i", block=8)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    stored = spark.read.parquet(f"{tmp_path}/i/postings")
    # Ids and lengths stand once a block, not once a posting.
    ids = [i for r in stored.where("term IS NULL").collect() for i in r.ids]
    assert len(ids) == len(set(ids)) and stored.where("term IS NOT NULL AND ids IS NOT NULL").count() == 0
    assert stored.where("term IS NOT NULL").groupBy("term", "block").count().where("count > 1").count() == 0
    assert hits(inverted.search(spark, f"{tmp_path}/i", "alpha delta the", 12)) == brute(texts, "alpha delta the", 12)
