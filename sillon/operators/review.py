"""The two-reviewer transcript workflow as a fold over events.

An item begins as a machine draft. Reviewer 1, then a different reviewer 2, then an approver move it on; it can be
rejected until it is approved or rejected; drafts change only the machine's text. Each event is answered by whether it
was accepted, why not, and the item's state after it. Reviewers are compared without white space at the ends.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold, fold_stream, states

DRAFT, FIRST, SECOND, APPROVED, REJECTED = "machine_draft", "reviewer_1_complete", "reviewer_2_complete", "approved", "rejected"
SCHEMA = "item_id string, seq long, action string, actor string, accepted boolean, error string, state string, text string"


def step(state: dict | None, event: dict) -> tuple[dict, dict]:
    """Answers one event: item_id, seq, action (draft, review_1, review_2, approve, reject), actor, text, reason."""
    item = dict(state or {"state": DRAFT, "machine": "", "first": None, "first_text": None, "second_text": None, "label": None})
    action = event["action"]
    actor, text, reason = ((event.get(k) or "").strip() for k in ("actor", "text", "reason"))
    text = " ".join(text.split())
    now, error = item["state"], None
    if action == "draft":
        if not text:
            error = "empty draft"
        elif now != DRAFT:
            error = "draft after review"
        else:
            item["machine"] = text
    elif action in ("review_1", "review_2"):
        second = action == "review_2"
        if second and item["first"] == actor and actor:
            error = "same reviewer"
        elif not actor or not text:
            error = "review needs actor and text"
        elif now != (FIRST if second else DRAFT):
            error = f"no review in state {now}"
        elif second:
            item.update(state=SECOND, second_text=text)
        else:
            item.update(state=FIRST, first=actor, first_text=text)
    elif action == "approve":
        if not actor:
            error = "approval needs actor"
        elif now != SECOND:
            error = f"no approval in state {now}"
        else:
            item.update(state=APPROVED, label=item["second_text"])
    elif action == "reject":
        if not actor or not reason:
            error = "rejection needs actor and reason"
        elif now in (APPROVED, REJECTED):
            error = f"no rejection in state {now}"
        else:
            item["state"] = REJECTED
    else:
        error = f"unknown action {action}"
    out = {"item_id": event["item_id"], "seq": event["seq"], "action": action, "actor": actor, "accepted": error is None, "error": error, "state": item["state"], "text": item["label"]}
    return item, out


def audit(events: DataFrame) -> DataFrame:
    """The answer to every event."""
    return fold(events, "item_id", ["seq"], step, SCHEMA)


def audit_stream(events: DataFrame, number: str = "seq", begin: DataFrame | None = None) -> DataFrame:
    """As ``audit``, for a stream whose ``number`` counts an item's events from 1, or on from where ``begin`` (``workflow_states``) ends."""
    return fold_stream(events, "item_id", number, step, SCHEMA, begin=begin)


def workflow_states(events: DataFrame, number: str = "seq") -> DataFrame:
    """Where the items stand after these events: item_id, number of the next event, state."""
    return states(events, "item_id", [number], number, step)


def final_states(events: DataFrame) -> DataFrame:
    """Each item's state after its last event, its label if approved, and how many events were accepted and refused."""
    last = F.max_by(F.struct("state", "text"), "seq").alias("last")
    return audit(events).groupBy("item_id").agg(last, F.count_if("accepted").alias("accepted"), F.count_if(F.expr("not accepted")).alias("refused")).select("item_id", "last.state", "last.text", "accepted", "refused")


def queue(items: DataFrame, limit: int, created: str = "created_at", key: str = "item_id", language: str | None = None, state: str | None = None) -> DataFrame:
    """The newest items, at most ``limit`` (1 to 1000)."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    if language is not None:
        items = items.filter(F.col("language") == language)
    if state is not None:
        items = items.filter(F.col("state") == state)
    return items.orderBy(F.desc(created), key).limit(limit)


def approved_labels(items: DataFrame) -> DataFrame:
    """Approved items as compiler input, all of them."""
    true = F.lit("true")
    return items.filter(F.col("state") == APPROVED).select("audio", F.col("approved_text").alias("text"), "speaker", "dialect", "source_id", true.alias("consent_attested"), true.alias("transcript_reviewed"))


def admitted(new: DataFrame, stored: DataFrame, order: str = "seq", digest: str = "sha256") -> DataFrame:
    """New items whose digest isn't stored yet, the first of each digest. Items without a digest are alike."""
    old = stored.select(F.col(digest).alias("sillon_digest")).distinct()
    fresh = new.join(old, new[digest].eqNullSafe(old["sillon_digest"]), "left_anti")
    first = fresh.groupBy(F.col(digest).alias("sillon_digest")).agg(F.min(order).alias("sillon_order"))
    return fresh.join(first, fresh[digest].eqNullSafe(first["sillon_digest"]) & fresh[order].eqNullSafe(first["sillon_order"]), "left_semi")


def item(items: DataFrame, key: str, value: str) -> DataFrame:
    """The row with an identifier; none is an error."""
    found = items.filter(F.col(key) == value)
    if found.isEmpty():
        raise LookupError(f"no item {value}")
    return found


def history(log: DataFrame, item_id: str) -> DataFrame:
    """The audit rows of an item in order."""
    return log.filter(F.col("item_id") == item_id).orderBy("seq")


def logged(events: DataFrame, path: str) -> DataFrame:
    """Appends events to an audit log and returns the log. Payloads are kept as JSON."""
    payload = F.to_json(F.struct("text", "reason")).alias("payload")
    events.select("item_id", "seq", "action", "actor", payload).write.mode("append").parquet(path)
    return events.sparkSession.read.schema("item_id string, seq long, action string, actor string, payload string").parquet(path)


def insert(new: DataFrame, path: str, order: str = "seq", digest: str = "sha256") -> DataFrame:
    """Appends what ``admitted`` lets in to a store and returns the store. One writer at a time; a failed write leaves nothing."""
    spark = new.sparkSession
    stored = spark.read.schema(new.schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], new.schema)
    admitted(new, stored, order, digest).write.mode("append").parquet(path)
    return spark.read.schema(new.schema).parquet(path)


def _exists(spark, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def pending_drafts(items: DataFrame, limit: int = 500, created: str = "created_at") -> DataFrame:
    """The newest items that wait for a draft, at most ``limit``."""
    return queue(items, limit, created, state=DRAFT)


def draft_totals(drafts: DataFrame) -> DataFrame:
    """One row: examined, drafted and failed, from the texts (or errors) of a batch of drafts."""
    fine = F.col("error").isNull() & F.coalesce(F.trim("text") != "", F.lit(False))
    return drafts.agg(F.count(F.lit(1)).alias("examined"), F.count_if(fine).alias("drafted"), F.count_if(~fine).alias("failures"))
