"""Counts that a pass takes of its own rows, in a batch or over a stream: nothing is read twice to be counted."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from .classify import DECODE_ERROR, STOPS


def classification(rows: DataFrame) -> dict[str, Column]:
    """What is counted of classified rows (see ``classify.in_chunks``), and what went wrong first of each kind."""
    kind = F.col("failure")
    counts = {
        "texts": F.count(F.lit(1)),
        "judged": F.count("toxic_token"),
        "toxic": F.count_if(F.col("toxic_token")),
        "decode_errors": F.count_if(F.col("model_id") == DECODE_ERROR),
        "retried": F.count_if(F.col("tries") > 1) if "tries" in rows.columns else F.lit(0),
    }
    failed = {k: F.count_if(kind == k) for k in STOPS}
    details = {f"{k}_detail": F.min(F.when(kind == k, F.coalesce("detail", F.lit("")))) for k in STOPS}
    return {k: v.alias(k) for k, v in {**counts, **failed, **details}.items()}


def watched(rows: DataFrame, counts: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """(rows, what they will have been): ``get`` of the second waits for the first to be run, and then holds its counts."""
    seen = Observation()
    return rows.observe(seen, *counts.values()), seen


class StreamCounts(StreamingQueryListener):
    """Sums of what streams observe under one name, micro-batch by micro-batch. Add it to the session before they start."""

    def __init__(self, name: str):
        self.name, self.total, self.batches, self._lock = name, Counter(), 0, threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            with self._lock:
                self.batches += 1
                self.total.update({k: v for k, v in row.asDict().items() if isinstance(v, int)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
