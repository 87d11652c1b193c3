"""Which recognition model serves a language: the shared one, or the language's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the columns of a registry of languages that decide about routes.
REGISTRY = "code string, name string, mode string, model string, model_kind string, runtime_language_hint string"


def routed(requests: DataFrame, registry: DataFrame, deployed: DataFrame | None = None, language: str = "language") -> DataFrame:
    """``requests`` with columns engine, hint and error.

    A request without a language goes to the shared engine without a hint. A language with mode ``shared`` (or none) goes
    there with its own hint, or its code; one with mode ``custom`` goes to its model, which, if it is local (as where no
    kind is given), ``deployed`` (model) must have. Anything else is an error and has no engine: an unknown language, mode
    or kind, or a custom mode without a model.
    """
    known = registry.select(F.col("code").alias("sillon_code"), *[F.nullif(F.trim(c), F.lit("")).alias(f"sillon_{c}") for c in ("mode", "model", "model_kind", "runtime_language_hint")])
    met = requests.join(known, requests[language] == known["sillon_code"], "left")
    if deployed is not None:
        there = deployed.select(F.col("model").alias("sillon_model")).distinct().withColumn("sillon_there", F.lit(True))
        met = met.join(there, "sillon_model", "left")
    else:
        met = met.withColumn("sillon_there", F.lit(True))
    mode, kind = F.coalesce("sillon_mode", F.lit("shared")), F.coalesce("sillon_model_kind", F.lit("local"))
    error = (
        F.when(F.col(language).isNull() | (F.col("sillon_code").isNotNull() & (mode == "shared")), F.lit(None).cast("string"))
        .when(F.col("sillon_code").isNull(), F.concat(F.lit("unknown language "), language))
        .when(mode != "custom", F.concat(F.lit("unknown mode "), mode))
        .when(F.col("sillon_model").isNull(), "no model")
        .when((kind == "local") & F.col("sillon_there").isNull(), F.concat(F.lit("not deployed: "), "sillon_model"))
        .when(~kind.isin("local", "remote"), F.concat(F.lit("unknown kind "), kind))
    )
    custom = F.col("sillon_code").isNotNull() & (mode == "custom")
    found = met.withColumn("error", error)
    return found.select(
        *requests.columns, F.when(F.col("error").isNull(), F.when(custom, F.col("sillon_model")).otherwise("shared")).alias("engine"),
        F.when(F.col("error").isNull(), F.when(custom, F.col("sillon_runtime_language_hint")).otherwise(F.coalesce("sillon_runtime_language_hint", "sillon_code"))).alias("hint"), "error",
    )
