"""Steps of a job that can be killed anywhere: what a step makes and that it is done are one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.store import State, Store

#: Makes tables from the store as of a state.
Step = Callable[[State], dict[str, DataFrame]]


def go_on(store: Store, job: str, run_id: str, steps: list[tuple[str, Step]], stop_after: str | None = None) -> bool:
    """Do the steps of a run that aren't done yet; False if it was stopped early.

    The marker is a table of the store, ``<job>_state``, and is committed with the tables of its step, upon the state that
    they were made from: a step is done wholly or not at all, and not twice. Another ``run_id`` begins anew. A marker that
    names no step fails.
    """
    names, marker = [n for n, _ in steps], f"{job}_state"
    done = -1
    if store.current(marker):
        last = store.read(marker).first()
        if last.run_id == run_id:
            if last.step not in names:
                raise ValueError(f"unknown step {last.step!r}")
            done = names.index(last.step)
    for name, step in steps[done + 1 :]:
        since = store.state()
        tables = step(since)
        told = store.spark.createDataFrame([(run_id, name)], "run_id string, step string")
        # A step that commits by itself, as an append does, gives no tables; it must be able to go twice.
        store.replace_all({**tables, marker: told}, since=since if tables else None)
        if name == stop_after:
            return False
    return True
