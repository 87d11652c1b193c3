"""Buffers of spoken turns as a fold over a connection's frames.

start opens a turn (again: drops what was held), audio adds bytes, commit ends and delivers it, cancel drops it. Audio or
commit without a turn is an error; so are a commit without audio, a rate outside 8 to 48 kHz, and unknown frames. Audio
beyond the greatest length is an error and drops the turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .folds import Step, fold, fold_stream

MOST_SECONDS = 90.0
DEFAULT_RATE = 16000
SCHEMA = "conn_id string, seq long, outcome string, n_bytes long, seconds double"


def stepper(most: float = MOST_SECONDS) -> Step:
    """A step on frames of conn_id, seq, kind, sample_rate, n_bytes."""

    def step(state: dict | None, frame: dict) -> tuple[dict | None, dict]:
        out = {"conn_id": frame["conn_id"], "seq": frame["seq"], "n_bytes": None, "seconds": None}
        kind = frame["kind"]
        if kind == "start":
            rate = int(frame["sample_rate"] if frame.get("sample_rate") is not None else DEFAULT_RATE)
            if not 8000 <= rate <= 48000:
                return state, out | {"outcome": "error:sample_rate"}
            return {"rate": rate, "bytes": 0, "chunks": 0}, out | {"outcome": "started"}
        if kind == "audio":
            if state is None:
                return None, out | {"outcome": "error:no_turn"}
            held = state["bytes"] + int(frame["n_bytes"] or 0)
            if held / (state["rate"] * 2) > most:
                return None, out | {"outcome": "error:too_long"}
            return state | {"bytes": held, "chunks": state["chunks"] + 1}, out | {"outcome": "buffered", "n_bytes": held}
        if kind == "cancel":
            return None, out | {"outcome": "cancelled"}
        if kind == "commit":
            if state is None:
                return None, out | {"outcome": "error:no_turn"}
            if not state["chunks"]:
                return None, out | {"outcome": "error:empty_turn"}
            return None, out | {"outcome": "committed", "n_bytes": state["bytes"], "seconds": state["bytes"] / (state["rate"] * 2)}
        return state, out | {"outcome": "error:unknown_frame"}

    return step


def turns(frames: DataFrame, most: float = MOST_SECONDS) -> DataFrame:
    """What becomes of every frame."""
    return fold(frames, "conn_id", ["seq"], stepper(most), SCHEMA)


def turns_stream(frames: DataFrame, most: float = MOST_SECONDS, number: str = "seq", idle: int | None = None) -> DataFrame:
    """As ``turns``, for a stream whose ``number`` counts a connection's frames from 1; a connection is forgotten after ``idle`` milliseconds."""
    return fold_stream(frames, "conn_id", number, stepper(most), SCHEMA, idle=idle)
