"""Source catalogues, acquisition plans, provider adapters, capped acquisition, imports and model pointers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillon.functions.text import WHITE, present, visible
from sillon.sources.workspace import materialize

#: Fixed value: uses from the freest to the narrowest.
USAGE_RANK = {"production": 0, "evaluation": 1, "research": 2}

CATALOG_SCHEMA = "source_id string, provider string, languages array<string>, tasks array<string>, usage string, license string, governance_approved boolean, upstream_validated boolean, training_only boolean, optional boolean"
PLAN_SCHEMA = "language string, task string, role string, position int, source_id string"


def rank(usage: Column) -> Column:
    """The rank of a use; an unknown one is an error."""
    ranks = F.create_map(*[F.lit(x) for kv in USAGE_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, usage), F.raise_error(F.concat(F.lit("unknown usage: "), usage)).cast("int"))


def allows(usage: Column, requested: Column) -> Column:
    """Whether a source of one use may be used for another."""
    return rank(requested) >= rank(usage)


def planned(catalog: DataFrame, language: str, task: str, requested: str) -> DataFrame:
    """Sources of a language and task that a use allows."""
    return catalog.filter(F.array_contains("languages", language) & F.array_contains("tasks", task) & allows(F.col("usage"), F.lit(requested)))


def resolved(plan: DataFrame, catalog: DataFrame) -> DataFrame:
    """The plan with its sources' catalogue columns. A source that the catalogue lacks is an error."""
    met = plan.join(catalog.withColumn("known", F.lit(True)), "source_id", "left")
    return met.filter(F.coalesce("known", F.raise_error(F.concat(F.lit("unknown source: "), "source_id")).cast("boolean"))).drop("known")


def _stripped(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def first_present(names: list[str], columns: list[str], needed: bool = True) -> Column:
    """The first of the named columns with anything but white space, as it is; an error, or null, where none has."""
    found = [F.when(visible(F.col(n).cast("string")), F.col(n).cast("string")) for n in names if n in columns]
    last = F.raise_error(F.lit(f"none of {names} is given")).cast("string") if needed else F.lit(None).cast("string")
    return F.coalesce(*found, last)


def adapt(rows: DataFrame, prefix: str, audio: list[str], text: list[str], ids: list[str], speaker: list[str] | None = None, speaker_needed: bool = False, dialect: str | None = None) -> DataFrame:
    """A provider's rows as audio, text, speaker, dialect, source_id, training_only; rows without speaker are for training only.

    Values stay as the provider gives them; dialects, and speakers that aren't needed, lose white space at their ends. An
    id counts if it isn't empty, even if blank.
    """
    c = rows.columns
    if not speaker:
        who = F.lit(None).cast("string")
    elif speaker_needed:
        who = first_present(speaker, c)
    else:
        who = F.coalesce(*[_stripped(F.nullif(F.col(n).cast("string"), F.lit(""))) for n in speaker if n in c], F.lit(None).cast("string"))
    sound = first_present(audio, c)
    own = F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in ids if n in c], sound)
    where = _stripped(F.nullif(F.col(dialect), F.lit(""))) if dialect in c else F.lit(None).cast("string")
    return rows.select(sound.alias("audio"), first_present(text, c).alias("text"), who.alias("speaker"), where.alias("dialect"), F.concat(F.lit(f"{prefix}:"), own).alias("source_id"), who.isNull().alias("training_only"))


def upstream_id(row_id: Column, index: Column) -> Column:
    """The trimmed id, or row- and nine digits of the index."""
    return F.coalesce(present(row_id), F.format_string("row-%09d", index))


def provenance(rows: DataFrame, source: dict, revision: str, sample_rate: int) -> DataFrame:
    """Acquired rows (audio, text, speaker, dialect, id, index) of a catalogue source as metadata with its licence basis.

    Rows are for training only if their source is, or if they have no speaker; a missing dialect is ``unknown``.
    """
    who = F.coalesce(_stripped(F.col("speaker").cast("string")), F.lit(""))
    where = F.coalesce(F.nullif(_stripped(F.col("dialect").cast("string")), F.lit("")), F.lit("unknown"))
    flag = lambda x: F.lit(bool(x)).cast("string")
    return rows.select(
        "audio", "text", who.alias("speaker"), where.alias("dialect"), F.concat(F.lit(source["source_id"] + ":"), upstream_id(F.col("id"), F.col("index"))).alias("source_id"),
        flag(False).alias("consent_attested"), flag(False).alias("transcript_reviewed"), flag(source["governance_approved"]).alias("governance_approved"), flag(source["upstream_validated"]).alias("upstream_validated"),
        (F.lit(bool(source["training_only"])) | (who == "")).cast("string").alias("training_only"), F.lit(source["license"]).alias("source_license"), F.lit(revision).alias("source_revision"),
        F.lit(f"licensed-external:{source['license']}").alias("governance_basis"), F.lit(source.get("repo_id") or "").alias("source_dataset"), F.lit(source.get("config") or "default").alias("source_config"),
        F.lit(source["split"]).alias("source_split"), F.lit(sample_rate).alias("sample_rate"),
    )


def reuse(requests: DataFrame, receipts: DataFrame, metadata: DataFrame, listing: DataFrame) -> DataFrame:
    """``requests`` (source_id, revision, sample_rate, max_samples) with column reusable: whether a finished acquisition may stand in.

    Its receipt (resolved_revision, sample_rate, requested_max_samples, metadata_sha256) must be of the same request, its
    metadata (source_id, audio, metadata_sha256) untouched and with a sound for each row that the listing (path) has.
    """
    lacking = metadata.join(listing.select(F.col("path").alias("audio")).distinct(), "audio", "left_anti").select("source_id").distinct().withColumn("lacking", F.lit(True))
    digests = metadata.groupBy("source_id").agg(F.max("metadata_sha256").alias("now"))
    r = receipts.select("source_id", "resolved_revision", F.col("sample_rate").alias("rate"), "requested_max_samples", "metadata_sha256")
    met = requests.join(r, "source_id", "left").join(digests, "source_id", "left").join(lacking, "source_id", "left")
    same = (F.col("resolved_revision") == F.col("revision")) & (F.col("rate") == F.col("sample_rate")) & F.col("requested_max_samples").eqNullSafe(F.col("max_samples")) & (F.col("now") == F.col("metadata_sha256"))
    return met.withColumn("reusable", F.coalesce(same & F.col("lacking").isNull(), F.lit(False))).select(*requests.columns, "reusable")


def lineage_differs(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key`` and the fields in which two lineages of it differ, nulls being alike."""
    met = a.alias("a").join(b.alias("b"), key)
    return met.select(key, F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields])).alias("fields"))


def deployed(pointers: DataFrame, cards: DataFrame, keys: list[str], model: str = "model_id") -> DataFrame:
    """Pointers with their models' cards; a model without a card is an error."""
    met = pointers.join(cards.withColumn("known", F.lit(True)), [*keys, model], "left")
    return met.filter(F.coalesce("known", F.raise_error(F.concat(F.lit("not registered: "), model)).cast("boolean"))).drop("known")


def evaluated(rows: DataFrame, split: str) -> DataFrame:
    """Rows of an evaluation split, and those that name none."""
    return rows.filter(F.coalesce(F.nullif(F.col("split"), F.lit("")), F.lit(split)) == split)


def upload_outcome(size: Column, several_speakers: Column, limit: int) -> Column:
    """Why an upload is refused, or accepted."""
    return F.when(several_speakers, "reject:multi_speaker").when(size > limit, "reject:too_large").when(F.coalesce(size, F.lit(0)) == 0, "reject:empty").otherwise("accepted")


def united(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """All rows of all parts with the given columns; what a part lacks is empty. Nothing is deduplicated."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*columns).na.fill("")


def capped(rows: DataFrame, source: str, index: str, digest: str, fine: Column, limit: int | None = None) -> DataFrame:
    """The outcome of an acquisition that stops after ``limit`` accepted rows of each source.

    Column outcome: imported, or skipped for rows that failed or repeat the digest of an accepted row before; rows after
    the last accepted one of a full source aren't read and left out.

    Ranks within a source need its rows in order: accepted rows only, narrowed to (source, index, digest) before the
    window, whose partitions adaptive execution can't split; ``limit`` keeps the rank short in Spark's group limit.
    """
    ok = rows.withColumn("fine", fine)
    first = ok.filter("fine").groupBy(source, digest).agg(F.min(index).alias("first"))
    met = ok.join(first, [source, digest], "left").withColumn("good", F.coalesce(F.col("fine") & (F.col(index) == F.col("first")), F.lit(False)))
    if limit is not None:
        good = met.filter("good").select(source, index)
        ranked = good.withColumn("n", F.row_number().over(Window.partitionBy(source).orderBy(index))).filter(F.col("n") <= limit)
        ends = ranked.filter(F.col("n") == limit).select(source, F.col(index).alias("end"))
        met = met.join(ends, source, "left").filter(F.col("end").isNull() | (F.col(index) <= F.col("end"))).drop("end")
    return met.withColumn("outcome", F.when(F.col("good"), "imported").otherwise("skipped")).drop("fine", "first", "good")


def acquired(outcomes: DataFrame, source: str, duration: str | None = None) -> DataFrame:
    """Imported and skipped rows of each source, and the hours of imported ones where ``duration`` (seconds) is given."""
    imported = F.col("outcome") == "imported"
    totals = [F.count_if(imported).alias("imported"), F.count_if(F.col("outcome") == "skipped").alias("skipped")]
    if duration:
        seconds = F.coalesce(F.sum(F.when(imported, F.col(duration).cast("decimal(18,6)"))), F.lit(0))
        totals.append(F.round(seconds.cast("double") / 3600, 6).alias("hours"))
    return outcomes.groupBy(source).agg(*totals)


def import_outcome(consent: Column, exists: Column, several_speakers: Column) -> Column:
    """The first rule that fails: consent and existence reject, several speakers go to quarantine."""
    return F.when(~consent, "reject:consent").when(~exists, "reject:missing_file").when(several_speakers, "quarantine:multi_speaker").otherwise("import")


def pointer_history(events: DataFrame, keys: list[str], model: str, order: list[str]) -> DataFrame:
    """Each pointer's predecessor under its keys, and whether it is the latest.

    Rows are ranged over tasks by key and order, so a frequent key fills several of them; windows lead from row to row
    within a range, and the border rows of each range, one for a key that goes on, hand the model over to the next.
    """
    own = events.columns
    spark = events.sparkSession
    rows = events.withColumn("sillon_key", F.struct(*[F.col(k) for k in keys]))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialize(rows.repartitionByRange(parts, *keys, *order).withColumn("sillon_part", F.spark_partition_id()), "ranged")
    at = F.struct(*[F.col(o) for o in order])
    borders = ranged.groupBy("sillon_key", "sillon_part").agg(F.min_by(F.struct(model), at).alias("first"), F.max_by(F.struct(model), at).alias("last"))
    over = Window.partitionBy("sillon_key").orderBy("sillon_part")
    borders = borders.select("sillon_key", "sillon_part", F.lag("last").over(over).alias("sillon_before"), F.lead("first").over(over).alias("sillon_after"))
    w = Window.partitionBy("sillon_key", "sillon_part").orderBy(*order)
    inside = ranged.withColumns({"sillon_lag": F.lag(F.struct(model)).over(w), "sillon_lead": F.lead(F.struct(model)).over(w)})
    met = inside.join(borders, ["sillon_key", "sillon_part"])
    return met.select(*own, F.coalesce("sillon_lag", "sillon_before")[model].alias("previous_model_id"), F.coalesce("sillon_lead", "sillon_after").isNull().alias("latest"))


def roll_backs(history: DataFrame, cards: DataFrame, keys: list[str], model: str = "model_id") -> DataFrame:
    """Where each key's latest pointer rolls back to: its predecessor, joined with that model's card. Pointers without one are left out."""
    latest = history.filter(F.col("latest") & F.col("previous_model_id").isNotNull())
    return deployed(latest.select(*keys, F.col(model).alias("rolled_back"), F.col("previous_model_id").alias(model)), cards, keys, model)


def latest_pointers(events: DataFrame, keys: list[str], model: str, order: list[str]) -> DataFrame:
    """The latest pointer under each key, by a grouped maximum."""
    return events.groupBy(*keys).agg(F.max_by(model, F.struct(*order)).alias(model))


def latest_checkpoint(paths: DataFrame, path: str = "path") -> DataFrame:
    """The path with the greatest numeric suffix; others are ignored."""
    step = F.regexp_extract(path, r"checkpoint-([0-9]{1,18})$", 1)
    return paths.withColumn("step", F.nullif(step, F.lit("")).cast("long")).filter("step is not null").agg(F.max_by(path, "step").alias(path), F.max("step").alias("step"))


def readiness(report: DataFrame, frontend: str, tokenizer_reviewed: bool, g2p_reviewed: bool, reviewed_graphemes: int) -> DataFrame:
    """The codes of what blocks a language, from one row of accepted_rows, train_rows, validation_rows, leaking_speakers, outside_reviewed."""
    given = {"language": "", "frontend": frontend, "tokenizer_reviewed": tokenizer_reviewed, "g2p_reviewed": g2p_reviewed, "reviewed_graphemes": reviewed_graphemes}
    return blockers_by_language(report.withColumns({k: F.lit(v) for k, v in given.items()})).select(F.posexplode("codes").alias("position", "code"))


def blockers_by_language(reports: DataFrame) -> DataFrame:
    """The codes of what blocks each language, from its report and what was reviewed: columns language, codes and blocked.

    Besides the counts of ``readiness`` a row has frontend, tokenizer_reviewed, g2p_reviewed and reviewed_graphemes.
    """
    rules = [
        ((F.col("accepted_rows") < 1) | (F.col("train_rows") < 1), "empty_training_corpus"),
        (F.col("leaking_speakers") > 0, "speaker_leakage"),
        (F.col("frontend") == "experiment", "frontend_unselected"),
        (~F.col("tokenizer_reviewed"), "tokenizer_unreviewed"),
        (F.col("reviewed_graphemes") == 0, "graphemes_unreviewed"),
        ((F.col("frontend") == "phoneme") & ~F.col("g2p_reviewed"), "g2p_unreviewed"),
        (F.col("validation_rows") < 1, "no_internal_validation"),
        (F.col("tokenizer_reviewed") & (F.col("reviewed_graphemes") > 0) & (F.col("outside_reviewed") > 0), "observed_outside_reviewed_inventory"),
    ]
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules]))
    return reports.select("language", codes.alias("codes")).withColumn("blocked", F.size("codes") > 0)


def readiness_status(blockers: DataFrame) -> DataFrame:
    """One row: whether every language is unblocked, and how many are not."""
    return blockers.agg(F.coalesce(F.bool_and(~F.col("blocked")), F.lit(False)).alias("ready"), F.count_if("blocked").alias("blocked"))


def reconciled(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Declared and observed row counts, one row each, side by side."""
    both = declared.select(F.col("n").alias("declared"), F.lit(None).cast("long").alias("observed")).unionByName(observed.select(F.lit(None).cast("long").alias("declared"), F.col("n").alias("observed")))
    return both.agg(F.max("declared").alias("declared"), F.max("observed").alias("observed")).withColumn("matches", F.col("declared").eqNullSafe(F.col("observed")))
