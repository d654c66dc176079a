"""A job queue as a stateful stream: first in, first out, with leases, attempts and cancellation.

Events of a queue are kept until the watermark has passed them and are then taken in the order of time and id, so the outcome
does not depend on the order in which they arrive.  A worker that gives no sign for ``lease`` seconds loses its job, which is
queued again behind the others or, after ``attempts`` tries, fails; an event-time timer sees to that when no event does.
The state of a queue is its live jobs and the events not yet due.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "queue string, job string, action string, worker string, attempt int, at timestamp"
STATE = "body string"
KINDS = ("submit", "claim", "beat", "done", "fail", "cancel")


@dataclass
class Queue:
    """Jobs by name: ``[attempt, worker or null, last sign]``; ``waiting`` in the order of their turn."""

    lease: int
    attempts: int
    jobs: dict[str, list] = field(default_factory=dict)
    waiting: list[str] = field(default_factory=list)

    def step(self, at: int, kind: str, job: str | None, worker: str | None) -> Iterator[tuple]:
        """What an event at ``at`` (milliseconds) brings about: ``job, action, worker, attempt, at``.  Events that fit no state do nothing."""
        yield from self.expire(at - 1)
        held = self.jobs.get(job)
        mine = held is not None and held[1] is not None and held[1] == worker
        if kind == "submit" and job is not None and held is None:
            self.jobs[job] = [0, None, at]
            self.waiting.append(job)
            yield job, "queued", None, 0, at
        elif kind == "claim" and worker is not None and self.waiting:
            job = self.waiting.pop(0)
            attempt = self.jobs[job][0] + 1
            self.jobs[job] = [attempt, worker, at]
            yield job, "started", worker, attempt, at
        elif kind == "beat" and mine:
            held[2] = at
        elif kind == "done" and mine:
            del self.jobs[job]
            yield job, "done", worker, held[0], at
        elif kind == "fail" and mine:
            yield from self._again(job, at)
        elif kind == "cancel" and held is not None:
            del self.jobs[job]
            if held[1] is None:
                self.waiting.remove(job)
            yield job, "cancelled", held[1], held[0], at

    def expire(self, upto: int) -> Iterator[tuple]:
        """Leases that have ended by ``upto``, the earliest first."""
        for end, job in sorted((j[2] + self.lease * 1000, name) for name, j in self.jobs.items() if j[1] is not None):
            if end <= upto:
                yield from self._again(job, end)

    def next_end(self) -> int | None:
        ends = [j[2] + self.lease * 1000 for j in self.jobs.values() if j[1] is not None]
        return min(ends) if ends else None

    def _again(self, job: str, at: int) -> Iterator[tuple]:
        attempt, worker, _ = self.jobs[job]
        if attempt >= self.attempts:
            del self.jobs[job]
            yield job, "failed", worker, attempt, at
        else:
            self.jobs[job] = [attempt, None, at]
            self.waiting.append(job)
            yield job, "requeued", worker, attempt, at


def run_queue(events: DataFrame, late: str = "10 minutes", lease: int = 60, attempts: int = 3) -> DataFrame:
    """``events(queue, ts, event_id, kind, job, worker)`` as a stream -> ``queue, job, action, worker, attempt, at``, appended.

    ``kind`` is one of ``KINDS``; others, null times and events behind the watermark do nothing.  ``claim`` takes the job whose
    turn it is; ``beat``, ``done`` and ``fail`` count only from the worker that holds the job.  A name may be submitted again
    when its job has ended.  Events of one time go by id, then kind, job and worker.
    """

    def act(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept: dict[str, Any] = json.loads(state.get[0]) if state.exists else {"jobs": {}, "waiting": [], "events": []}
        queue = Queue(lease, attempts, kept["jobs"], kept["waiting"])
        pending = kept["events"]
        mark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for pdf in batches:
                at = pdf.ts.astype("datetime64[ms, UTC]" if pdf.ts.dt.tz is not None else "datetime64[ms]").astype("int64")
                rows = zip(at, pdf.event_id, pdf.kind, pdf.job, pdf.worker, strict=True)
                pending += [[int(t), int(i), k, None if pd.isna(j) else j, None if pd.isna(w) else w] for t, i, k, j, w in rows if t >= mark]
        pending.sort(key=lambda e: [str(x or "") if n > 1 else x for n, x in enumerate(e)])
        due = [e for e in pending if e[0] < mark]
        pending = pending[len(due) :]
        out = [row for t, _, k, j, w in due for row in queue.step(t, k, j, w)]
        out += list(queue.expire(mark - 1))
        if queue.jobs or pending:
            state.update((json.dumps({"jobs": queue.jobs, "waiting": queue.waiting, "events": pending}),))
            wake = [x for x in (queue.next_end(), pending[0][0] if pending else None) if x is not None]
            if wake:
                state.setTimeoutTimestamp(max(min(wake), mark) + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame([(key[0], j, a, w, n, pd.Timestamp(t, unit="ms")) for j, a, w, n, t in out], columns=["queue", "job", "action", "worker", "attempt", "at"])

    rows = events.where(F.col("ts").isNotNull() & F.col("queue").isNotNull() & F.col("event_id").isNotNull() & F.col("kind").isin(*KINDS))
    rows = rows.select(F.col("queue").cast("string").alias("queue"), "ts", F.col("event_id").cast("long").alias("event_id"), "kind", F.col("job").cast("string").alias("job"), F.col("worker").cast("string").alias("worker"))
    return rows.withWatermark("ts", late).groupBy("queue").applyInPandasWithState(act, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
