"""Recognition benchmarks: error rates, slices, latency, real-time factor, and listening scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillon.functions.edits import error_counts
from sillon.functions.text import for_error_rate
from sillon.sources.workspace import materialize

SLICES = ("speaker", "dialect", "noise", "code_switch")


def counted(utterances: DataFrame, normalize: bool = True) -> DataFrame:
    """``utterances`` (reference, hypothesis) with edits and reference lengths, worked out once for all groupings."""
    ready = utterances.withColumns({f"_{c}": for_error_rate(F.col(c)) if normalize else F.col(c) for c in ("reference", "hypothesis")})
    return ready.withColumns(error_counts(F.col("_reference"), F.col("_hypothesis"))).drop("_reference", "_hypothesis")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def summary() -> list[Column]:
    """Sums of edits and lengths, and the ratios of the sums."""
    sums = [F.sum(c).alias(c) for c in ("word_errors", "reference_words", "char_errors", "reference_chars")]
    return [F.count(F.lit(1)).alias("utterances"), *sums, ratio(F.sum("word_errors"), F.sum("reference_words")).alias("wer"), ratio(F.sum("char_errors"), F.sum("reference_chars")).alias("cer")]


def error_rates(counts: DataFrame) -> DataFrame:
    """One row of global error rates."""
    return counts.agg(*summary())


def slices(counts: DataFrame, attributes: tuple[str, ...] = SLICES, default: str = "unknown") -> DataFrame:
    """Error rates by each value of each attribute, from one pass: rows are doubled by attribute before they are summed."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.nullif(F.col(a), F.lit("")), F.lit(default)).alias("value")) for a in attributes])
    return counts.select("*", F.explode(pairs).alias("slice")).groupBy(F.col("slice.attribute").alias("attribute"), F.col("slice.value").alias("value")).agg(*summary())


#: Rows up to which a group's percentiles come from one table of its values.
DIRECT_ROWS = 100_000
#: Groups and ranks up to which their state is broadcast to the rows.
BROADCAST_RANKS = 500_000
#: Points of a grid of approximate percentiles, and its accuracy.
GRID, ACCURACY = 256, 4096


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """``by`` and p, the exact interpolated percentiles of each group; groups without a value have none.

    Small groups have their values counted at once. In large ones each rank that a percentile asks for is looked for
    between two bounds: approximate percentiles of the rows between them give two closer values, and all rows are counted
    against these exactly, so that a wrong guess only costs a round. Equal values meet in one count and end the search,
    whatever their number; what is left between the bounds shrinks by about a hundred each round, and is counted value by
    value when it is small. No task holds the values of a group.
    """
    # one struct for the group: its fields have any names and may be null
    known = rows.filter(F.col(value).isNotNull()).select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(by)]).alias("g"), F.col(value).cast("double").alias("v"))
    named = [F.col(f"g.c{i}").alias(c) for i, c in enumerate(by)]
    sizes = materialize(known.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    if (sizes.agg(F.max("n")).first()[0] or 0) <= DIRECT_ROWS:
        return known.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).select(*named, "p")
    at = lambda k: (F.col("n") - 1) * F.lit(float(shares[k]))
    ranks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(j).alias("j"), f(at(k)).cast("long").alias("rank")) for k in range(len(shares)) for j, f in ((0, F.floor), (1, F.ceil))])
    asked = sizes.select("g", "n", F.explode(ranks).alias("x")).select("g", "n", "x.*")
    found = _ranked(known, asked.select("g", "rank", "n").distinct())
    ends = asked.join(found, ["g", "rank"]).groupBy("g", "n", "k").agg(F.max(F.when(F.col("j") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("j") == 1, F.col("v"))).alias("high"))
    place = (F.col("n") - 1) * F.element_at(F.array(*map(F.lit, map(float, shares))), F.col("k") + 1)
    part = place - F.floor(place)
    ends = ends.withColumn("p", F.when(part == 0, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * part))
    return ends.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "p"))).alias("all")).select(*named, F.transform("all", lambda x: x["p"]).alias("p"))


def _ranked(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (g, rank from 0, n) with v, the value of that rank among the rows of ``known`` (g, v)."""
    # lo and hi bound the rank's value, both exclusive, null where there is no bound; below counts the values up to lo
    state = materialize(wanted.select("g", "rank", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.lit(None).cast("double").alias("v")), "ranks")
    done = None
    while True:
        ended = state.filter("v is not null").select("g", "rank", "v")
        done = ended if done is None else done.unionByName(ended)
        state = state.filter("v is null").drop("v")
        sizes = state.agg(F.count(F.lit(1)).alias("n"), F.max("inside").alias("most")).first()
        if not sizes.n:
            return done
        held = lambda state: known.join(F.broadcast(state) if sizes.n <= BROADCAST_RANKS else state, "g").filter("(lo is null or v > lo) and (hi is null or v < hi)")  # noqa: B023, E731
        if sizes.most <= DIRECT_ROWS:
            counts = held(state).groupBy("g", "rank", "below", "v").agg(F.count(F.lit(1)).alias("n"))
            upto = F.sum("n").over(Window.partitionBy("g", "rank").orderBy("v")) + F.col("below")
            return done.unionByName(counts.withColumn("upto", upto).filter("rank < upto and rank >= upto - n").select("g", "rank", "v"))
        # two approximate values around the rank among the rows between the bounds
        grid = held(state).groupBy("g", "rank").agg(F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], F.lit(ACCURACY)).alias("grid"))
        place = (F.col("rank") - F.col("below")) / F.col("inside") * GRID
        point = lambda i: F.element_at("grid", F.greatest(F.lit(0), F.least(F.lit(GRID), i)).cast("int") + 1)
        closer = materialize(state.join(grid, ["g", "rank"]).select("g", "rank", "lo", "hi", "below", point(F.floor(place) - 1).alias("a"), point(F.ceil(place) + 1).alias("b")), "pivots")
        split = held(closer).groupBy("g", "rank", "lo", "hi", "below", "a", "b").agg(
            F.count_if(F.col("v") < F.col("a")).alias("n0"), F.count_if(F.col("v") == F.col("a")).alias("n1"), F.count_if((F.col("v") > F.col("a")) & (F.col("v") < F.col("b"))).alias("n2"),
            F.count_if((F.col("v") == F.col("b")) & (F.col("a") < F.col("b"))).alias("n3"), F.count_if(F.col("v") > F.col("b")).alias("n4"),
        )
        left = F.col("rank") - F.col("below")
        sums = [F.lit(0).cast("long")]
        for i in range(5):
            sums.append(sums[-1] + F.col(f"n{i}"))
        parts = [("lo", "a", None), (None, None, "a"), ("a", "b", None), (None, None, "b"), ("b", "hi", None)]
        choice = F.lit(None)
        for i, (lo, hi, v) in reversed(list(enumerate(parts))):
            column = lambda c: F.col(c) if c else F.lit(None).cast("double")
            here = F.struct(column(lo).alias("lo"), column(hi).alias("hi"), (F.col("below") + sums[i]).alias("below"), F.col(f"n{i}").alias("inside"), column(v).alias("v"))
            choice = here if i == 4 else F.when(left < sums[i + 1], here).otherwise(choice)
        state = materialize(split.withColumn("next", choice).select("g", "rank", "next.*"), "ranks")


def latency(rows: DataFrame, by: list[str] | None = None, value: str = "latency_seconds") -> DataFrame:
    """Mean and interpolated median and 95th percentile, exact. Means sum decimals, so that order is of no account."""
    keys = by or ["all"]
    given = rows if by else rows.withColumn("all", F.lit(0))
    means = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col(value).cast("decimal(18,6)")).cast("double") / F.count(value)).alias("mean"))
    out = means.join(percentiles(given, keys, value, [0.5, 0.95]), keys, "left")
    return out.select(*(by or []), "n", "mean", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"))


def real_time_factor(rows: DataFrame) -> DataFrame:
    """Summed latency over summed sound, negative values as 0."""
    total = lambda c: F.sum(F.greatest(F.col(c), F.lit(0.0)).cast("decimal(18,6)")).cast("double")
    return rows.agg(ratio(total("latency_seconds"), total("audio_seconds")).alias("rtf"))


def histogram(rows: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """How many values of each group fall into each bucket of a width."""
    return rows.groupBy(*by, F.floor(F.col(value) / F.lit(float(width))).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gates(report: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Whether each figure of a one-row report is within its limit."""
    return report.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(v).alias("most"), F.coalesce(F.col(k) <= v, F.lit(False)).alias("passed")) for k, v in limits.items()])).alias("g")).select("g.*")


METRICS = ("naturalness", "pronunciation", "intelligibility", "speaker_similarity")


def listening_scores(ratings: DataFrame) -> DataFrame:
    """Mean of each metric by model, to four places, and the number of ratings. Values outside 1 to 5 are an error; rows without a model are left out."""
    valid = lambda m: F.when(F.col(m).between(1.0, 5.0), F.col(m)).otherwise(F.when(F.col(m).isNotNull(), F.raise_error(F.lit(f"{m} must be between 1 and 5"))))
    rows = ratings.withColumn("model_id", F.trim("model_id")).filter("model_id <> ''").select("model_id", *[valid(m).alias(m) for m in METRICS])
    means = [F.round(F.sum(F.col(m).cast("decimal(18,6)")).cast("double") / F.count(m), 4).alias(m) for m in METRICS]
    return rows.groupBy("model_id").agg(F.greatest(*[F.count(m) for m in METRICS]).alias("ratings"), *means)
