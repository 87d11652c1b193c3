"""Ordered folds over the events of a key: in batch, and with the same steps as a streaming query.

A step takes the key's state (None at first) and an event and returns the new state and an output row.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Step = Callable[[dict | None, dict], tuple[dict | None, dict]]


def _rows(pdf: pd.DataFrame) -> Iterator[dict]:
    """The rows, column by column as plain values; what is missing is None."""
    columns = {}
    for name, values in pdf.items():
        held = values.tolist()
        if values.isna().any():
            held = [None if gone else x for x, gone in zip(held, values.isna().tolist(), strict=True)]
        columns[name] = held
    names = list(columns)
    return (dict(zip(names, row, strict=True)) for row in zip(*columns.values(), strict=True))


def fold(events: DataFrame, key: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """The outputs of all events. Rows stream through in order, so a key's events needn't fit in memory; they stay in one task, as their order asks."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames):
        now, state = object(), None
        for pdf in frames:
            out = []
            for row in _rows(pdf):
                if row[key] != now:
                    now, state = row[key], None
                state, made = step(state, row)
                out.append([made.get(n) for n in names])
            yield pd.DataFrame(out, columns=names).astype(object)

    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def states(events: DataFrame, key: str, order: list[str], number: str, step: Step) -> DataFrame:
    """What a fold over a key's events leaves: ``key``, number (of the next event) and state as JSON, to begin a stream with."""

    def run(frames):
        now, state, last = object(), None, None
        for pdf in frames:
            out = []
            for row in _rows(pdf):
                if row[key] != now:
                    if last is not None:
                        out.append([now, last + 1, json.dumps(state)])
                    now, state = row[key], None
                state, last = step(state, row)[0], int(row[number])
            yield pd.DataFrame(out, columns=["key", "number", "state"])
        if last is not None:
            yield pd.DataFrame([[now, last + 1, json.dumps(state)]], columns=["key", "number", "state"])

    kind = events.schema[key].dataType.simpleString()
    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"key {kind}, number long, state string").withColumnRenamed("key", key)


class OrderedFold(StatefulProcessor):
    """A fold over numbered events of a key, in the order of their numbers, whatever the batches that bring them.

    The value state holds the number that comes next and the step's state; events that come before their predecessors wait
    in a list. A number that is past is a repeated delivery and is passed over. When nothing comes for ``idle``
    milliseconds, what waits is taken in order in spite of the gap and the key is forgotten, so state is bounded by the
    keys that are alive.
    """

    def __init__(self, number: str, step: Step, names: list[str], first: int, idle: int | None) -> None:
        self.number, self.step, self.names, self.first, self.idle = number, step, names, first, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "number long, state string")
        self.waiting = handle.getListState("waiting", "event string")

    def _made(self, state: dict | None, event: dict) -> tuple[dict | None, Row]:
        state, made = self.step(state, event)
        return state, Row(**{n: made.get(n) for n in self.names})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        number, text = self.held.get() if self.held.exists() else (self.first, None)
        state = json.loads(text) if text else None
        early = [(e[self.number], i, e) for i, (x,) in enumerate(self.waiting.get()) for e in [json.loads(x)]] if self.waiting.exists() else []
        had, k = bool(early), len(early)
        heapq.heapify(early)
        for row in rows:
            k += 1
            heapq.heappush(early, (row[self.number], k, row.asDict()))
            while early and early[0][0] <= number:
                at, _, event = heapq.heappop(early)
                if at == number:
                    state, out = self._made(state, event)
                    number += 1
                    yield out
        self.held.update((number, json.dumps(state)))
        if early:
            self.waiting.put([(json.dumps(e),) for _, _, e in sorted(early)])
        elif had:
            self.waiting.clear()
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        text = self.held.get()[1] if self.held.exists() else None
        state = json.loads(text) if text else None
        left = [json.loads(x) for (x,) in self.waiting.get()] if self.waiting.exists() else []
        for event in sorted(left, key=lambda e: e[self.number]):
            state, out = self._made(state, event)
            yield out
        self.held.clear()
        self.waiting.clear()

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:  # noqa: N802, N803
        self.held.update((initialState["number"], initialState["state"]))

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, key: str, number: str, step: Step, schema: str, first: int = 1, idle: int | None = None, begin: DataFrame | None = None) -> DataFrame:
    """The outputs of a streaming DataFrame's events, which ``number`` counts from ``first`` for each key: those of ``fold``.

    ``idle`` is how many milliseconds after its last event a key is forgotten (None: never), ``begin`` what ``states``
    gave for events before the stream.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    processor = OrderedFold(number, step, names, first, idle)
    return events.groupBy(key).transformWithState(processor, schema, "Append", "None" if idle is None else "ProcessingTime", begin.groupBy(key) if begin is not None else None)
