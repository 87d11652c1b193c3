"""The registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import artifacts, corpus, intake, streams, workflow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**corpus.QUERIES, **workflow.QUERIES, **artifacts.QUERIES, **streams.QUERIES, **intake.QUERIES}
ORACLES: dict[str, str] = {**corpus.ORACLES, **workflow.ORACLES, **artifacts.ORACLES, **streams.ORACLES, **intake.ORACLES}
