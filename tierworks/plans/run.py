"""Build a layer table by table, or independent tables at once: a failure is recorded and the rest goes on."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tierworks.operators import ledger
from tierworks.sources import write_layer


class RejectedSource(RuntimeError):
    """The sources of a table are too incomplete to build it."""


@dataclass(frozen=True)
class Spec:
    """A table to build: its name, what builds it, its sources, and the one-row quality score of the sources
    that decides whether it is written."""

    name: str
    build: Callable[[SparkSession], DataFrame]
    sources: Sequence[str] = ()
    score: DataFrame | None = None
    partition_by: Sequence[str] = ()


def new_run_id(track: str = "metadata") -> str:
    """Sorts by time; runs of one second differ by their suffix."""
    return f"{track}_{ledger.now():%Y%m%dT%H%M%S}_{uuid.uuid4().hex[:12]}"


def run_layer(
    spark: SparkSession,
    layer: str,
    specs: Sequence[Spec],
    pipeline: str,
    scenario: str | None = None,
    location: str | None = None,
    track: str = "metadata",
    suffix: str = "",
    run_id: str | None = None,
) -> DataFrame:
    """Write every table and return one ledger entry per table.

    Parts of one pipeline's run share a ``run_id`` (see :func:`new_run_id`); without one the call is a run.

    An entry holds the score and the status of the table's sources; a table written from quarantined sources
    carries the status as its property ``quality_status``. The rows are counted on the written table, whose file footers hold the answer, so
    each table is computed once.
    """
    run_id = run_id or new_run_id(track)
    about = (pipeline, scenario or "default", track)
    return ledger.records(spark, [(run_id, *about, *_written(spark, layer, spec, scenario, location, suffix)) for spec in specs])


def _written(spark: SparkSession, layer: str, spec: Spec, scenario: str | None, location: str | None, suffix: str) -> tuple:
    """Write one table: times, name, rows, whether it was written, error, score and status."""
    started = ledger.now()
    rows, error, score, status = None, None, None, None
    try:
        if spec.score is not None:
            score, status = spec.score.select("quality_score", "status").first()
        if status == "REJECT":
            raise RejectedSource(f"REJECT: quality score {score}")
        full = write_layer(spec.build(spark), layer, spec.name + suffix, scenario, list(spec.partition_by) or None, location)
        if status == "QUARANTINE":
            spark.sql(f"ALTER TABLE {full} SET TBLPROPERTIES ('quality_status' = 'QUARANTINE')")
        rows = spark.table(full).count()
    except (PySparkException, Py4JError, ValueError, RuntimeError) as exc:
        error = str(exc).splitlines()[0]
    return started, ledger.now(), spec.name + suffix, rows, error is None, error, score, status


def order(specs: Sequence[Spec]) -> dict[str, set[str]]:
    """For every table the tables of the list it is built from. A circle among them, or a repeated name, is an error."""
    names = [s.name for s in specs]
    if len(set(names)) < len(names):
        raise ValueError("a table is listed twice")
    needs = {s.name: set(s.sources) & set(names) for s in specs}
    left = dict(needs)
    while left:
        ready = [n for n, of in left.items() if not of & set(left)]
        if not ready:
            raise ValueError(f"tables are built from one another: {', '.join(sorted(left))}")
        for n in ready:
            del left[n]
    return needs


def run_graph(
    spark: SparkSession,
    layer: str,
    specs: Sequence[Spec],
    pipeline: str,
    at_once: int = 4,
    scenario: str | None = None,
    location: str | None = None,
    track: str = "metadata",
    suffix: str = "",
    run_id: str | None = None,
) -> DataFrame:
    """:func:`run_layer` with tables that don't rest on one another written at the same time, ``at_once`` at most.

    A table waits for those of its sources that are in the list; if one of them was not written, neither is the table, and its
    entry names that source. Every table's jobs run in a scheduler pool of its own, so with ``spark.scheduler.mode`` FAIR
    a small table does not wait behind a large one. Entries come in the order of the list.
    """
    needs, run_id = order(specs), run_id or new_run_id(track)
    about = (run_id, pipeline, scenario or "default", track)
    waiting, done, running = {s.name: s for s in specs}, {}, {}

    def write(spec: Spec) -> tuple:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{pipeline}-{spec.name}")
        try:
            return _written(spark, layer, spec, scenario, location, suffix)
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(at_once) as pool:
        while waiting or running:
            for name in [n for n in waiting if needs[n] <= set(done)]:
                spec = waiting.pop(name)
                lost = sorted(n for n in needs[name] if not done[n][4])
                if lost:
                    now = ledger.now()
                    done[name] = (now, now, name + suffix, None, False, f"source {lost[0]} was not written", None, None)
                else:
                    running[pool.submit(inheritable_thread_target(spark)(write), spec)] = name
            if running and not any(needs[n] <= set(done) for n in waiting):
                for finished in wait(running, return_when=FIRST_COMPLETED).done:
                    done[running.pop(finished)] = finished.result()
    return ledger.records(spark, [(*about, *done[s.name]) for s in specs])
