"""The watched folder over three steps with a restart, update results over several batches, and long dictionary terms."""

import os

import pytest

from folio_spark.operators import knowledge, search
from folio_spark.streaming import folder
from folio_spark.streaming import windows as sw


def put(path, text, at):
    path.write_text(text)
    os.utime(path, (at, at))


def test_folder_over_three_steps(spark, tmp_path):
    box, ticks = tmp_path / "box", tmp_path / "ticks"
    box.mkdir(), ticks.mkdir()
    clock = lambda: spark.readStream.schema("value string").text(str(ticks))

    def step(n):  # each step is a new query on the same checkpoint: a restart
        (ticks / f"{n}.txt").write_text("tick")
        folder.watch(spark, clock(), str(box), str(tmp_path / "store"), str(tmp_path / "ck"), "*.txt").awaitTermination()

    put(box / "a.txt", "one", 1000), put(box / "b.txt", "two", 1000), put(box / "c.txt", "three", 1000), put(box / "x.bin", "other", 1000)
    step(1)
    put(box / "a.txt", "changed", 2000), put(box / "c.txt", "three", 2000), (box / "b.txt").unlink(), put(box / "d.txt", "new", 2000)
    step(2)
    put(box / "e.txt", "old time", 500), (box / "d.txt").unlink(), put(box / "d.txt", "new", 3000)
    step(3)
    found = sorted((r.tick, r.path.rsplit("/", 1)[1], r.change) for r in folder.events(spark, str(tmp_path / "store")).collect())
    assert found == [
        (0, "a.txt", "created"), (0, "b.txt", "created"), (0, "c.txt", "created"),
        (1, "a.txt", "modified"), (1, "b.txt", "deleted"), (1, "d.txt", "created"), (2, "e.txt", "created"),
    ]


def test_a_tick_run_again_gives_the_same_events(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", None)], "path string, checksum string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4"), ("n", None)], "path string, checksum string")
    assert sorted(tuple(r) for r in folder.changes(old, new).select("path", "change").collect()) == [("b", "modified"), ("c", "created"), ("n", "modified")]
    assert folder.changes(new.limit(0), old.limit(0)).count() == 0


def test_updates_of_all_batches_count(spark, tmp_path):
    rows = "event_type string, event_id long, user_id long, ts timestamp"
    for n, user in enumerate((1, 2)):
        spark.sql(f"SELECT 'e{n}' AS event_type, {n}L AS event_id, {user}L AS user_id, TIMESTAMP'2024-01-01' AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: sw.latest_status(spark.readStream.schema(rows).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    assert sorted((r.user_id, r.status) for r in sw.drain(stream(), "update", ["user_id"]).collect()) == [(1, "e0"), (2, "e1")]
    with pytest.raises(ValueError):
        sw.drain(stream(), "update")


def test_terms_of_any_length_match(spark):
    words = spark.createDataFrame([(1, 1, "one two three four five six", "short")], "stage int, ord int, term string, variant string")
    q = spark.createDataFrame([("say one two three four five six now",)], ["query"])
    assert [r.expanded for r in search.expand_by_dictionary(q, words).orderBy("position").collect()][1] == "say short now"
    assert search.expand_by_dictionary(q, words.limit(0)).count() == 1


def test_empty_outline(spark):
    none = spark.createDataFrame([], "ord int, section string, keywords array<string>")
    assert knowledge.assign_sections(spark.createDataFrame([(1, "x")], "cluster_id long, text string"), none).first().section is None
