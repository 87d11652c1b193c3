"""Lineage kept in small files on the driver: tree digests, ids, receipts, lineage equality, deployment pointers, phases."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillon.sources.sinks import json_report


def compact(value) -> bytes:
    """JSON with sorted keys, no spaces and ASCII only, over which digests are taken."""
    return json.dumps(value, sort_keys=True, separators=(",", ":")).encode()


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def tree_digest(files: DataFrame, root: str, ignored: str = "model_card.json") -> tuple[str, list[dict]]:
    """The digest of a folder's files (columns path, content, sha256), and their list in order of paths. A folder without files is an error."""
    below = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + os.path.abspath(root).rstrip("/") + "/", "")
    rows = files.select(below.alias("path"), F.octet_length("content").alias("bytes"), "sha256").filter(F.substring_index("path", "/", -1) != ignored).collect()
    found = sorted((r.asDict() for r in rows), key=lambda r: tuple(r["path"].split("/")))
    if not found:
        raise ValueError(f"{root} has no files")
    return hashlib.sha256(compact(found)).hexdigest(), found


def json_text(text: Column) -> Column:
    """Text as JSON of ASCII characters alone, in quotes."""
    short = {0x22: '\\"', 0x5C: "\\\\", 0x08: "\\b", 0x09: "\\t", 0x0A: "\\n", 0x0C: "\\f", 0x0D: "\\r"}
    unit = lambda x: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(x), 4, "0")))

    def one(char: Column) -> Column:
        code = F.ascii(char)
        out = F.when((code >= 0x20) & (code < 0x80), char)
        for k, v in short.items():
            out = F.when(code == k, F.lit(v)).otherwise(out)
        above = code - 0x10000
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(above, 10)), unit(F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))))
        return F.coalesce(out, F.when(code >= 0x10000, pair).otherwise(unit(code)))

    return F.concat(F.lit('"'), F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), ""), F.lit('"'))


def tree_digests(files: DataFrame, tree: str, ignored: str = "model_card.json") -> DataFrame:
    """``tree``, files and sha256: the digest of each tree's files (relative path, bytes, sha256), by the compact JSON of their list.

    The list is in the order of paths, part by part. It is one value: a tree has as many files as a model has.
    """
    kept = files.filter(F.substring_index("path", "/", -1) != ignored)
    line = F.concat(F.lit('{"bytes":'), F.col("bytes").cast("string"), F.lit(',"path":'), json_text(F.col("path")), F.lit(',"sha256":"'), "sha256", F.lit('"}'))
    rows = kept.groupBy(tree).agg(F.array_sort(F.collect_list(F.struct(F.split("path", "/").alias("parts"), line.alias("line")))).alias("all"))
    return rows.select(tree, F.size("all").cast("long").alias("files"), F.sha2(F.concat(F.lit("["), F.array_join(F.transform("all", lambda r: r["line"]), ","), F.lit("]")), 256).alias("sha256"))


def model_ids(trees: DataFrame, language: str, task: str, digest: str = "sha256") -> DataFrame:
    """``trees`` with column model_id: language, task and twelve digits of the tree's digest."""
    return trees.withColumn("model_id", F.concat(language, F.lit("-"), task, F.lit("-"), F.left(F.col(digest), F.lit(12))))


def experiment_digest(fields: list[str]) -> Column:
    """Twelve digits of the digest of compact JSON of the fields of a plan, all text, by their names."""
    parts = F.array(*[F.concat(F.lit(json.dumps(f) + ":"), F.coalesce(json_text(F.col(f)), F.lit("null"))) for f in sorted(fields)])
    return F.left(F.sha2(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")), 256), F.lit(12))


def model_id(language: str, task: str, digest: str) -> str:
    return f"{language}-{task}-{digest[:12]}"


def experiment_id(identity: dict) -> str:
    """Twelve digits of the identity's digest."""
    return hashlib.sha256(compact(identity)).hexdigest()[:12]


def differences(a: dict, b: dict, fields: list[str]) -> list[str]:
    """The fields in which two lineages differ; absent and null are alike."""
    return [f for f in fields if a.get(f) != b.get(f)]


def reusable(receipt: dict, metadata: str, revision: str, sample_rate: int, most: int | None, exists: Callable[[str], bool] = os.path.exists) -> bool:
    """Whether a finished acquisition may stand in for a new one: same request, untouched metadata."""
    wanted = {"resolved_revision": revision, "sample_rate": sample_rate, "requested_max_samples": most}
    return exists(metadata) and not differences(receipt, wanted, list(wanted)) and receipt.get("metadata_sha256") == file_digest(metadata)


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()


class Pointers:
    """Which model serves a task, language and stage. Pointers are replaced as a whole and name their predecessor."""

    STAGES = ("staging", "production", "retired")

    def __init__(self, root: str):
        self.root = root

    def _card(self, task: str, language: str, model: str) -> str:
        return os.path.join(self.root, "registry", task, language, model, "model_card.json")

    def _pointer(self, task: str, language: str, stage: str) -> str:
        return os.path.join(self.root, "deployments", task, language, f"{stage}.json")

    @staticmethod
    def _read(path: str) -> dict | None:
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def register(self, task: str, language: str, model: str, artifact: str, metadata: dict) -> None:
        """Writes a model's card, once."""
        path = self._card(task, language, model)
        if os.path.exists(path):
            raise FileExistsError(path)
        if not os.path.exists(artifact):
            raise FileNotFoundError(artifact)
        json_report({"task": task, "language": language, "model_id": model, "artifact_path": os.path.abspath(artifact), "registered_at": _now(), "metadata": metadata}, path)

    def current(self, task: str, language: str, stage: str) -> dict | None:
        return self._read(self._pointer(task, language, stage))

    def promote(self, task: str, language: str, model: str, stage: str) -> dict:
        """Points a stage at a registered model."""
        card = self._read(self._card(task, language, model))
        if stage not in self.STAGES or card is None:
            raise ValueError(f"{model} isn't registered, or {stage} is no stage")
        before = self.current(task, language, stage)
        pointer = {"task": task, "language": language, "stage": stage, "model_id": model, "artifact_path": card["artifact_path"], "updated_at": _now(), "previous_model_id": before and before["model_id"]}
        json_report(pointer, self._pointer(task, language, stage))
        return pointer

    def roll_back(self, task: str, language: str, stage: str = "production") -> dict:
        """Points a stage at the predecessor."""
        now = self.current(task, language, stage)
        if not now or not now["previous_model_id"]:
            raise ValueError("no predecessor")
        return self.promote(task, language, now["previous_model_id"], stage)


def run_phases(phases: list[tuple[str, Callable[[], object]]], path: str) -> dict:
    """Runs phases in order and keeps their states in a file; finished ones aren't run again, a failure is noted and raised."""
    states = Pointers._read(path) or {}
    for name, work in phases:
        if states.get(name, {}).get("state") == "done":
            continue
        states[name] = {"state": "running", "at": _now()}
        json_report(states, path)
        try:
            work()
        except Exception as e:
            states[name] = {"state": "failed", "at": _now(), "error": f"{type(e).__name__}: {e}"[:500]}
            json_report(states, path)
            raise
        states[name] = {"state": "done", "at": _now()}
        json_report(states, path)
    return states
