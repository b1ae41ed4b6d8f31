"""Computations side by side, each with a time limit and a record of what it took."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

RECORD = "name string, status string, rows long, seconds double, cpu_seconds double, peak_mb double, shuffle_mb double, spill_mb double, jobs int, message string"


def _took(spark: SparkSession, group: str) -> dict[str, Any]:
    """CPU, memory, shuffle and spill of a job group's stages, from the status store."""
    sc = spark.sparkContext
    store, stages, jobs = sc._jsc.sc().statusStore(), set(), 0
    every = store.jobsList(None)
    for i in range(every.size()):
        job = every.apply(i)
        if job.jobGroup().isDefined() and job.jobGroup().get() == group:
            jobs += 1
            ids = job.stageIds()
            stages |= {ids.apply(k) for k in range(ids.size())}
    out = {"cpu_seconds": 0.0, "peak_mb": 0.0, "shuffle_mb": 0.0, "spill_mb": 0.0, "jobs": jobs}
    for k in stages:
        try:
            s = store.lastStageAttempt(k)
        except Exception:  # noqa: BLE001  a stage that was skipped has no attempt, an old one may be gone
            continue
        out["cpu_seconds"] += s.executorCpuTime() / 1e9
        out["peak_mb"] = max(out["peak_mb"], s.peakExecutionMemory() / 1e6)
        out["shuffle_mb"] += s.shuffleWriteBytes() / 1e6
        out["spill_mb"] += s.diskBytesSpilled() / 1e6
    return out


def profiled(spark: SparkSession, tasks: dict[str, Callable[[], DataFrame]], limit: float = 86_400.0, at_once: int = 4) -> DataFrame:
    """RECORD of each task: its outcome is computed to the end, its rows counted. Up to at_once run side by side, so that one's last
    tasks leave room for another's first.

    A task that takes more than `limit` seconds (the default is a day) is cancelled, with the jobs that it has started, and has the
    status `timeout`; one that raises has `failed` and its message; the others go on. A task that computes on the driver for long is
    not interrupted, but the next job that it starts is cancelled.
    """

    def run(name: str, task: Callable[[], DataFrame]) -> tuple:
        sc, group = spark.sparkContext, f"edgeloom-{uuid.uuid4().hex}"
        sc.setJobGroup(group, name, interruptOnCancel=True)
        late, ended, began = threading.Event(), threading.Event(), time.monotonic()

        def watch() -> None:
            if not ended.wait(limit):
                late.set()
                while not ended.wait(0.2):  # jobs that it starts meanwhile go too
                    sc.cancelJobGroup(group)

        watcher = threading.Thread(target=inheritable_thread_target(spark)(watch), daemon=True)
        watcher.start()
        rows, status, message = None, "done", None
        try:
            rows = task().count()
        except Exception as e:  # noqa: BLE001  the record says what it was
            status, message = ("timeout", None) if late.is_set() else ("failed", str(e).split("\n")[0][:500])
        ended.set()
        watcher.join()
        took = _took(spark, group)
        return (name, status, rows, time.monotonic() - began, *(took[c] for c in ("cpu_seconds", "peak_mb", "shuffle_mb", "spill_mb", "jobs")), message)

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        records = list(pool.map(lambda x: inheritable_thread_target(spark)(run)(*x), tasks.items()))
    return spark.createDataFrame(records, RECORD)
