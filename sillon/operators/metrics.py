"""Figures that a job gives on its way: observed accepted and rejected rows and stage timings, in batch and as streams."""

from __future__ import annotations

import threading
import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def outcome_figures() -> list[Column]:
    """Rows with and without reasons."""
    return [F.count(F.lit(1)).alias("rows"), F.count_if(F.size("reasons") == 0).alias("accepted"), F.count_if(F.size("reasons") > 0).alias("rejected")]


def timing_figures(value: str, bounds: list[float]) -> list[Column]:
    """Count and sum of a timing, and how many are up to each bound, as a histogram of a monitoring system counts them."""
    upto = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return [F.count(value).alias("count"), F.coalesce(F.sum(F.col(value).cast("decimal(18,6)")), F.lit(0)).cast("double").alias("sum"), *upto]


def observed(rows: DataFrame, name: str, figures: list[Column]) -> tuple[DataFrame, Observation]:
    """``rows``, and the figures that are there once an action has read all of them; they cost no pass of their own."""
    seen = Observation(name)
    return rows.observe(seen, *figures), seen


class Figures(StreamingQueryListener):
    """Adds up the figures that a stream's batches report under a name: ``DataFrame.observe(name, ...)``."""

    def __init__(self, name: str) -> None:
        self.name, self.totals, self.batches, self.lock = name, {}, set(), threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        with self.lock:
            if (batch := (event.progress.runId, event.progress.batchId)) not in self.batches:
                self.batches.add(batch)
                for k, v in row.asDict().items():
                    self.totals[k] = self.totals.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def settled(figures: Figures, batches: int, seconds: float = 30.0) -> None:
    """Waits until so many batches have reported: reports come after the batches, on a thread of their own."""
    until = time.monotonic() + seconds
    while len(figures.batches) < batches and time.monotonic() < until:
        time.sleep(0.05)
    if len(figures.batches) < batches:
        raise TimeoutError(f"{len(figures.batches)} of {batches} batches have reported")
