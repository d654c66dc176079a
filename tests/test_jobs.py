"""The job queue: its rules one by one, and a stream in any arrival order against a replay of the sorted log."""

import random
from datetime import datetime, timedelta

from folio_spark.streaming import jobs
from folio_spark.streaming import windows as sw

START = datetime(2024, 1, 1)


def replay(events, lease, attempts, upto):
    queue, out = jobs.Queue(lease, attempts), []
    for t, _, kind, job, worker in sorted(events, key=lambda e: [str(x or "") if n > 1 else x for n, x in enumerate(e)]):
        if t < upto:
            out += list(queue.step(t, kind, job, worker))
    return out + list(queue.expire(upto - 1))


def said(rows):
    return [(job, action, worker, attempt) for job, action, worker, attempt, _ in rows]


def test_rules():
    s = 1000
    turn = [(0, 1, "submit", "a", None), (0, 2, "submit", "b", None), (0, 3, "submit", "a", None), (1, 4, "claim", None, "w"), (2, 5, "claim", None, "v"), (3, 6, "done", "a", "v"), (4, 7, "done", "a", "w")]
    assert said(replay(turn, 60, 3, 10)) == [("a", "queued", None, 0), ("b", "queued", None, 0), ("a", "started", "w", 1), ("b", "started", "v", 1), ("a", "done", "w", 1)]
    # A silent worker loses its job at the end of the lease; it goes behind the others and fails after the last try.
    silent = [(0, 1, "submit", "a", None), (1 * s, 2, "claim", None, "w"), (2 * s, 3, "submit", "b", None), (70 * s, 4, "done", "a", "w"), (71 * s, 5, "claim", None, "v"), (72 * s, 6, "claim", None, "v")]
    assert said(replay(silent, 60, 2, 500 * s))[3:] == [("a", "requeued", "w", 1), ("b", "started", "v", 1), ("a", "started", "v", 2), ("b", "requeued", "v", 1), ("a", "failed", "v", 2)]
    beats = [(0, 1, "submit", "a", None), (0, 2, "claim", None, "w"), (50 * s, 3, "beat", "a", "w"), (100 * s, 4, "beat", "a", "x"), (105 * s, 5, "done", "a", "w")]
    assert said(replay(beats, 60, 2, 500 * s))[-1] == ("a", "done", "w", 1)
    stop = [(0, 1, "submit", "a", None), (0, 2, "submit", "b", None), (1, 3, "cancel", "a", None), (2, 4, "claim", None, "w"), (3, 5, "cancel", "b", None), (4, 6, "done", "b", "w"), (5, 7, "fail", "zz", "w")]
    assert said(replay(stop, 60, 2, 500 * s))[2:] == [("a", "cancelled", None, 0), ("b", "started", "w", 1), ("b", "cancelled", "w", 1)]


def test_stream_equals_replay_in_any_arrival_order(spark, tmp_path):
    rng = random.Random(3)
    events = []
    for n in range(160):
        kind = rng.choices(jobs.KINDS, [4, 4, 2, 2, 1, 0.5])[0]
        events.append((rng.choice("pq"), rng.randrange(0, 900_000, 500), n, kind, rng.choice("abcdef") if kind != "claim" else None, rng.choice("xyz") if kind != "submit" else None))
    batches = [[] for _ in range(3)]
    for e in sorted(events, key=lambda e: e[1] + rng.randrange(0, 100_000)):  # within the lateness
        batches[min(2, e[1] // 300_000)].append(e)
    batches.append([("end", 10_000_000, 9999, "submit", "z", None)])  # moves the watermark past everything
    schema = "queue string, ts timestamp, event_id long, kind string, job string, worker string"
    for batch in batches:
        rng.shuffle(batch)
        rows = [(q, START + timedelta(milliseconds=t), i, k, j, w) for q, t, i, k, j, w in batch] + [("p", None, 1, "submit", "n", None), (None, START, 1, "submit", "n", None), ("p", START, 1, "odd", "n", None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {"p": [], "q": []}
    for r in sw.drain(jobs.run_queue(stream, "200 seconds", 60, 2), "append").collect():
        got[r["queue"]].append((r["job"], r["action"], r["worker"], r["attempt"], int((r["at"] - START).total_seconds() * 1000)))
    for q in "pq":
        want = replay([e[1:] for e in events if e[0] == q], 60, 2, 9_000_000)
        assert sorted(got[q], key=str) == sorted(want, key=str)
        assert {a for _, a, *_ in want} >= {"queued", "started", "requeued", "failed"}
