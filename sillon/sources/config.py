"""Catalogues, plans and language profiles: YAML on the driver, checked row by row, handed on as DataFrames.

YAML gives plain mappings; a declared schema turns each into a row, so that the same checks hold for rows from elsewhere.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillon.functions.text import nfc_casefold, squeezed
from sillon.operators.compiler import Policy
from sillon.operators.governance import CATALOG_SCHEMA, PLAN_SCHEMA, USAGE_RANK

TASKS, ROLES = ("asr", "tts"), ("train", "eval")


def _yaml(path: str) -> dict:
    """The mapping of a file on the driver, or of a text of several lines."""
    import yaml

    if "\n" in path:
        found, path = yaml.safe_load(path), "text"
    else:
        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f)
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path}: not a mapping")
    return found


def _words(value) -> list[str]:
    return [w for w in (str(v).strip() for v in value or []) if w]


def catalog_rows(path: str) -> list[dict]:
    """The catalogue's sources as rows; every fault of the file is named at once."""
    sources = _yaml(path).get("sources")
    if not isinstance(sources, dict):
        raise ValueError(f"{path}: sources must be a mapping")
    rows, faults = [], []
    for name, s in sources.items():
        s = s if isinstance(s, dict) else {}
        row = {
            "source_id": str(name), "languages": _words(s.get("languages")), "tasks": _words(s.get("tasks")), "usage": str(s.get("usage", "")).strip(), "license": str(s.get("license", "unknown")).strip(),
            **{k: (str(s[k]).strip() or None) if s.get(k) is not None else None for k in ("provider", "repo_id", "revision", "config", "data_files_glob")},
            "split": str(s.get("split", "train")).strip(), "fields": {str(k): str(v) for k, v in (s.get("fields") or {}).items() if v is not None} if isinstance(s.get("fields") or {}, dict) else None,
            **{k: bool(s.get(k, k == "requires_revision_pin")) for k in ("requires_revision_pin", "governance_approved", "upstream_validated", "training_only", "gated", "optional")},
        }
        rules = [(row["usage"] in USAGE_RANK, "usage"), (row["languages"], "languages"), (row["tasks"] and set(row["tasks"]) <= set(TASKS), "tasks"), (row["fields"] is not None, "fields"), (not row["data_files_glob"] or row["repo_id"], "repo_id of data_files_glob")]
        faults += [f"{name}: {what}" for ok, what in rules if not ok]
        rows.append(row)
    if faults:
        raise ValueError(f"{path}: {'; '.join(faults)}")
    return rows


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue as a table."""
    names = [c.split()[0] for c in CATALOG_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in catalog_rows(path)], CATALOG_SCHEMA)


def plan(spark: SparkSession, path: str) -> DataFrame:
    """The plan as a table; positions keep the order of the file."""
    rows = []
    for language, tasks in (_yaml(path).get("languages") or {}).items():
        for task, roles in tasks.items():
            for role, sources in roles.items():
                if role not in ROLES or not isinstance(sources, list):
                    raise ValueError(f"{path}: {language}.{task}.{role} must be a list of sources to train or to evaluate")
                rows += [(str(language), str(task), role, i, s) for i, s in enumerate(_words(sources))]
    return spark.createDataFrame(rows, PLAN_SCHEMA)


#: Fixed value: the least sample rate of an acquisition, in hertz.
LEAST_RATE = 8000


def admissible(source: dict, language: str, task: str, role: str, providers: Collection[str] | None = None, max_samples: int | None = None, sample_rate: int | None = None) -> list[str]:
    """Why a source may not be acquired for a language, task and role; empty if it may.

    ``providers``, where given, are those that have a reader; ``max_samples`` and ``sample_rate`` are what is asked for.
    """
    train = role == "train"
    rules = [
        (language in source["languages"], "language"), (task in source["tasks"], "task"),
        (not train or source["usage"] == "production", "not for production training"), (train or source["usage"] in ("evaluation", "production"), "not for evaluation"),
        (providers is None or source["provider"] in providers, "provider"), (max_samples is None or max_samples >= 1, "max_samples"), (sample_rate is None or sample_rate >= LEAST_RATE, "sample_rate"),
    ]
    return [what for ok, what in rules if not ok]


def profile(path: str) -> dict:
    """A language profile: sections language, corpus, asr, tts and reviewed_graphemes, with defaults, checked."""
    raw = _yaml(path)
    for section in ("language", "corpus", "asr", "tts"):
        if not isinstance(raw.get(section), dict):
            raise ValueError(f"{path}: {section} must be a mapping")
    language, corpus, asr, tts = (raw[k] for k in ("language", "corpus", "asr", "tts"))
    out = {
        "language": {k: str(language.get(k, "")).strip() for k in ("code", "iso639_3", "name", "script", "runtime_normalizer")} | {"aliases": _words(language.get("aliases"))},
        "corpus": {"min_seconds": 0.5, "max_seconds": 20.0, "require_mono": True, "split_unit": "speaker", "require_consent": True, "require_reviewed_transcript": True} | corpus | {"required_metadata": _words(corpus.get("required_metadata"))},
        "asr": {"language_token_mode": "none", "decoder_language": None, "sample_rate": 16000} | asr,
        "tts": {"sample_rate": 22050, "frontend": "experiment", "tokenizer_reviewed": False, "g2p_reviewed": False} | tts,
        "reviewed_graphemes": raw.get("reviewed_graphemes"),
    }
    mode, decoder = out["asr"]["language_token_mode"], out["asr"]["decoder_language"]
    rules = [
        (all(v for k, v in out["language"].items() if k != "aliases"), "language needs code, iso639_3, name, script and runtime_normalizer"),
        (out["corpus"]["split_unit"] in ("speaker", "audio"), "corpus.split_unit"), (mode in ("none", "explicit"), "asr.language_token_mode"), ((mode == "explicit") == bool(decoder), "asr.decoder_language"),
        (out["tts"]["frontend"] in ("grapheme", "phoneme", "experiment"), "tts.frontend"), (out["reviewed_graphemes"] is None or isinstance(out["reviewed_graphemes"], list), "reviewed_graphemes"),
    ]
    faults = [what for ok, what in rules if not ok]
    if faults:
        raise ValueError(f"{path}: {'; '.join(faults)}")
    return out


def policy(found: dict | None, min_seconds: float | None = None, max_seconds: float | None = None, fixed_split: str | None = None) -> Policy:
    """What the compiler asks of rows: given bounds before the profile's, these before the defaults."""
    corpus = found["corpus"] if found else {}
    bound = lambda given, name, default: given if given is not None else float(corpus.get(name, default))
    return Policy(
        bound(min_seconds, "min_seconds", 0.5), bound(max_seconds, "max_seconds", 20.0), split_by_speaker=bool(found) and corpus["split_unit"] == "speaker", require_mono=bool(corpus.get("require_mono", True)),
        require_consent=bool(found) and bool(corpus["require_consent"]), require_review=bool(found) and bool(corpus["require_reviewed_transcript"]), required=frozenset(corpus.get("required_metadata", ())), fixed_split=fixed_split,
    )


def profiles(folder: str | list[str]) -> dict[str, dict]:
    """The profiles of a folder, or of some texts, by code; a code or alias, in any case, that two share is an error."""
    found = [profile(p) for p in (sorted(glob.glob(os.path.join(folder, "*.yaml"))) if isinstance(folder, str) else folder)]
    owners: dict[str, set[int]] = {}
    for i, p in enumerate(found):
        for name in (p["language"]["code"], *p["language"]["aliases"]):
            owners.setdefault(name.casefold(), set()).add(i)
    shared = sorted(k for k, v in owners.items() if len(v) > 1)
    if shared:
        raise ValueError(f"{folder}: several profiles have {', '.join(shared)}")
    return {p["language"]["code"]: p for p in found}


def aliases(spark: SparkSession, found: dict[str, dict]) -> DataFrame:
    """Columns alias (folded) and code of all profiles."""
    rows = [(name.casefold(), code) for code, p in found.items() for name in (code, *p["language"]["aliases"])]
    return spark.createDataFrame(sorted(set(rows)), "alias string, code string")


def canonical(rows: DataFrame, known: DataFrame, column: str = "language", needed: bool = True, most: int = 100_000) -> DataFrame:
    """``rows`` with column code; an unknown alias is an error, or null where none is needed. Up to ``most`` aliases are broadcast."""
    few = F.broadcast(known) if known.count() <= most else known
    met = rows.withColumn("alias", nfc_casefold(squeezed(F.col(column)))).join(few, "alias", "left")
    if needed:
        met = met.withColumn("code", F.coalesce("code", F.raise_error(F.concat(F.lit("unknown language: "), F.coalesce(column, F.lit("none")))).cast("string")))
    return met.drop("alias")
