"""How far a write has come, while it runs.

`watched` runs an action in a thread of its own and polls, in the caller's, the
status that Spark keeps of the jobs which the action's thread starts: tasks that are
done and to do, and rows that finished tasks wrote. Nothing is added to the plan, so
the write is as fast as without it. Figures come from the driver alone.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from contextlib import suppress
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import InheritableThread
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Progress:
    """rows and tasks done, tasks known, seconds so far; each: seconds a row; remaining: seconds to go at this pace, None as long as there is none."""

    rows: int
    tasks: int
    of_tasks: int
    seconds: float
    each: float | None
    remaining: float | None


def progress(rows: int, tasks: int, of_tasks: int, seconds: float, total: int | None = None) -> Progress:
    """total: rows to come in all, if known; else the share of tasks that are done stands for that of rows."""
    share = rows / total if total else tasks / of_tasks if of_tasks else 0.0
    remaining = max(0.0, seconds / share - seconds) if share else None
    return Progress(rows, tasks, of_tasks, seconds, seconds / rows if rows else None, remaining)


def _figures(sc, group: str) -> tuple[int, int, int]:
    """Rows written, tasks done and tasks known of a group's jobs. Stages that were skipped count as done."""
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    rows = done = known = 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            s = tracker.getStageInfo(stage)
            if s is None or not s.numTasks:
                continue
            known += s.numTasks
            done += s.numTasks if info.status == "SUCCEEDED" else s.numCompletedTasks
            with suppress(Py4JJavaError):  # the store keeps the last thousand stages
                rows += store.lastStageAttempt(stage).outputRecords()
    return rows, done, known


def watched(df: DataFrame, write: Callable[[DataFrame], object], report: Callable[[Progress], object], total: int | None = None, every: float = 1.0) -> Progress:
    """Run write(df), call report with how far it has come every so many seconds and once more at its end, and return the last figures.

    Rows count when the task that wrote them has ended. What write raises is raised
    here; figures that report got until then stand.
    """
    sc, group = df.sparkSession.sparkContext, f"watched-{uuid.uuid4().hex}"
    failed: list[BaseException] = []

    def run() -> None:
        sc.setJobGroup(group, "watched", interruptOnCancel=True)
        try:
            write(df)
        except BaseException as e:  # noqa: BLE001  raised again in the caller's thread
            failed.append(e)

    began, ended = time.monotonic(), threading.Event()
    worker = InheritableThread(target=lambda: (run(), ended.set()), session=df.sparkSession)
    worker.start()
    try:
        while not ended.wait(every):
            report(progress(*_figures(sc, group), time.monotonic() - began, total))
    except BaseException:
        sc.cancelJobGroup(group)
        raise
    finally:
        worker.join()
    if failed:
        raise failed[0]
    last = Progress(*_settled(sc, group), time.monotonic() - began, None, None)
    last = progress(last.rows, last.of_tasks, last.of_tasks, last.seconds, last.rows or None)
    report(last)
    return last


def _settled(sc, group: str, patience: float = 5.0) -> tuple[int, int, int]:
    """The last figures: the status store may lag behind the end of a job for a moment."""
    until, before = time.monotonic() + patience, (-1, 0, 0)
    while (now := _figures(sc, group)) != before and time.monotonic() < until:
        before = now
        time.sleep(0.2)
    return now
