"""Waveforms: statistics, downmix, resampling, PCM, and segmentation by energy."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, StringType, StructField, StructType

from sillon.operators.compiler import suspicious
from sillon.operators.folds import Step, fold, fold_stream

#: Fixed values of the segmentation: frame, silence that ends a region, longest and shortest region, padding, in seconds.
FRAME, SILENCE, LONGEST, SHORTEST, PAD = 0.02, 0.45, 20.0, 0.6, 0.08


def statistics(samples: Column, rate: Column) -> dict[str, Column]:
    """Duration, peak, root mean square, clipped share and offset of an array of samples."""
    n = F.size(samples)
    wide = F.transform(samples, lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return {
        "duration": n / rate,
        "peak": F.coalesce(F.array_max(F.transform(wide, F.abs)), F.lit(0.0)),
        "rms": F.sqrt(total(F.transform(wide, lambda x: x * x)) / F.nullif(n, F.lit(0))),
        "clipped": F.size(F.filter(wide, lambda x: F.abs(x) >= 0.999)) / F.nullif(n, F.lit(0)),
        "offset": total(wide) / F.nullif(n, F.lit(0)),
    }


def inspected(rows: DataFrame, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """``rows`` with the statistics and whether they are suspicious."""
    found = rows.withColumns(statistics(F.col(samples), F.col(rate)))
    return found.withColumn("suspicious", suspicious(F.col("duration"), F.col("rms"), F.col("clipped"), F.col("offset")))


def pcm_seconds(n_bytes: Column, rate: Column, channels: int = 1) -> Column:
    """Seconds of 16-bit PCM."""
    return n_bytes / (rate * channels * 2)


def downmixed(samples: Column, channels: Column) -> Column:
    """Interleaved samples of several channels as the mean of the channels."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    mean = lambda i: F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0), lambda s, x: s + x) / channels
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), mean)).otherwise(F.array().cast("array<double>"))


def resampled_column(samples: Column, rate: Column, target: int) -> Column:
    """``resampled`` as a column expression."""
    n = F.size(samples)
    m = F.greatest(F.lit(1), F.rint(n * F.lit(float(target)) / rate).cast("int"))
    at = lambda i: F.element_at(samples, (F.least(i, n - 1) + 1).cast("int")).cast("double")

    def value(j: Column) -> Column:
        x = j * n.cast("double") / m
        i = F.floor(x)
        return at(i) + (at(i + 1) - at(i)) * (x - i)

    return F.when(n == 0, samples.cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), m - 1), value))


def resampled(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation to another rate; at least one sample.

    Sample k of n stands at k / n of the recording in either rate, and what lies beyond the last sample has its value.
    """
    if rate == target or not len(samples):
        return samples
    n = max(1, round(len(samples) * target / rate))
    return np.interp(np.arange(n) * (len(samples) / n), np.arange(len(samples)), samples).astype(np.float32)


class SoundError(ValueError):
    """A sound that can't be used."""


def decode(content: bytes) -> tuple[np.ndarray, int, int]:
    """Interleaved samples from -1 to 1, rate and channels of a PCM WAV file of 8, 16, 24 or 32 bits."""
    if not content:
        raise SoundError("audio is empty")
    try:
        with wave.open(io.BytesIO(content)) as w:
            width, rate, channels, raw = w.getsampwidth(), w.getframerate(), w.getnchannels(), w.readframes(w.getnframes())
    except (wave.Error, EOFError) as e:
        raise SoundError(f"audio can't be read: {e}") from e
    if width == 1:
        samples = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8)[: len(raw) // 3 * 3].reshape(-1, 3)
        samples = (wide.view("<i4").ravel() / 2**31).astype(np.float32)
    else:
        samples = (np.frombuffer(raw, f"<i{width}") / 2 ** (8 * width - 1)).astype(np.float32)
    return samples, rate, channels


def mono(samples: np.ndarray, channels: int) -> np.ndarray:
    """The mean of the channels of interleaved samples."""
    return samples if channels == 1 else samples[: len(samples) // channels * channels].reshape(-1, channels).mean(axis=1).astype(np.float32)


#: Seconds by which a sound may be longer than its cap.
SLACK = 0.05


def clip(content: bytes, target: int, most: float) -> np.ndarray:
    """The samples of a sound file, as one channel at the target rate; a longer sound than ``most`` seconds is an error."""
    samples, rate, channels = decode(content)
    samples = mono(samples, channels)
    if len(samples) / rate > most + SLACK:
        raise SoundError(f"recording exceeds maximum duration of {most:g}s")
    return resampled(samples, rate, target)


def _decoded(content: pa.Array) -> pa.Array:
    out = []
    for x in content.to_pylist():
        try:
            samples, rate, channels = decode(x or b"")
            out.append({"samples": samples, "rate": rate, "channels": channels, "error": None})
        except SoundError as e:
            out.append({"samples": None, "rate": None, "channels": None, "error": str(e)})
    return pa.array(out, pa.struct([("samples", pa.list_(pa.float32())), ("rate", pa.int32()), ("channels", pa.int32()), ("error", pa.string())]))


#: Samples, rate and channels of sound files, or why they can't be read.
decoded = F.arrow_udf(_decoded, StructType([StructField("samples", ArrayType(FloatType())), StructField("rate", IntegerType()), StructField("channels", IntegerType()), StructField("error", StringType())]))


def _figures(content: pa.Array) -> pa.Array:
    out = []
    for x in content:
        try:
            samples, rate, channels = decode(x.as_py() or b"")
        except SoundError as e:
            out.append({"error": str(e)})
            continue
        one = mono(samples, channels)
        n, wide = len(one), one.astype(np.float64)
        found = {"rate": rate, "channels": channels, "duration": n / rate, "peak": float(np.abs(wide).max(initial=0.0))}
        if n:
            found |= {"rms": float(np.sqrt(wide @ wide / n)), "clipped": float((np.abs(wide) >= 0.999).mean()), "offset": float(wide.sum() / n)}
        out.append(found)
    return pa.array(out, _FIGURES)


_FIGURES = pa.struct([("rate", pa.int32()), ("channels", pa.int32()), *[(c, pa.float64()) for c in ("duration", "peak", "rms", "clipped", "offset")], ("error", pa.string())])

#: The figures of sound files in one pass from their bytes (rate, channels, those of ``statistics`` over the mean of the channels), or why they can't be read.
measured_sound = F.arrow_udf(_figures, from_arrow_type(_FIGURES))


def normalized_clips(files: DataFrame, target: int = 16000, most: float = 120.0, key: str = "path", content: str = "content") -> DataFrame:
    """Columns ``key``, wav, seconds and error of single utterances: one channel, the target rate, no segmentation."""

    def run(frames):
        for pdf in frames:
            rows = []
            for k, x in zip(pdf[key], pdf[content], strict=True):
                try:
                    samples = clip(x or b"", target, most)
                    rows.append((k, wav(samples, target), len(samples) / target, None))
                except SoundError as e:
                    rows.append((k, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "wav", "seconds", "error"])

    return files.select(key, content).mapInPandas(run, f"{key} {dict(files.dtypes)[key]}, wav binary, seconds double, error string")


def payload(given: Column, stored: Column) -> Column:
    """The bytes of a sound given as bytes, as a path whose content was joined as ``stored``, or as samples and a rate.

    ``given`` is a struct of bytes, path, array and sampling_rate, of which the first that is there counts; nothing is an error.
    """
    made = wav_of_samples(given["array"].cast("array<float>"), given["sampling_rate"])
    neither = F.raise_error(F.concat(F.lit("no content for "), F.coalesce(given["path"], F.lit("an empty sound")))).cast("binary")
    return F.coalesce(given["bytes"], F.when(given["path"].isNotNull(), stored), F.when(given["array"].isNotNull() & (given["sampling_rate"] > 0), made), neither)


def leveled(samples: np.ndarray) -> np.ndarray:
    """Finite samples, brought down to a peak of 1 where they exceed it; anything else is an error."""
    flat = np.squeeze(np.asarray(samples, dtype=np.float32))
    if flat.ndim > 1 or not flat.size or not np.isfinite(flat).all():
        raise SoundError("samples must be finite and of one channel")
    peak = float(np.abs(flat).max())
    return np.atleast_1d(flat / peak if peak > 1 else flat)


def reference_fault(seconds: Column, channels: Column, least: float = 1.0, most: float = 30.0) -> Column:
    """Why a clip can't serve as a voice's reference, null if it can."""
    return F.when(channels != 1, "not mono").when(seconds < least, "too short").when(seconds > most, "too long")


def wav(samples: np.ndarray, rate: int) -> bytes:
    """A mono 16-bit WAV file; values beyond 1 are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1.0, 1.0) * np.float32(32767)).astype("<i2").tobytes())
    return out.getvalue()


def _lists(samples: pa.ListArray) -> Iterator[np.ndarray | None]:
    """Each row's samples as a view of the array's values; a row without, or with a null among them, is None."""
    values = samples.values.cast(pa.float32())
    holes = np.asarray(values.is_null())
    flat, bounds, given = values.fill_null(0).to_numpy(zero_copy_only=False), samples.offsets.to_numpy(), np.asarray(samples.is_valid())
    for i, there in enumerate(given.tolist()):
        a, b = bounds[i], bounds[i + 1]
        yield flat[a:b] if there and not holes[a:b].any() else None


def _wavs(samples: pa.Array, rate: pa.Array) -> pa.Array:
    return pa.array([None if s is None or r is None else wav(s, r) for s, r in zip(_lists(samples), rate.to_pylist(), strict=True)], pa.binary())


def _leveled_wavs(samples: pa.Array, rate: pa.Array) -> pa.Array:
    return pa.array([wav(leveled(np.array([np.nan]) if s is None else s), r) for s, r in zip(_lists(samples), rate.to_pylist(), strict=True)], pa.binary())


#: WAV files of samples, clipped at 1; and of samples brought down to 1 first.
wav_of_samples = F.arrow_udf(_wavs, BinaryType())
wav_of_leveled = F.arrow_udf(_leveled_wavs, BinaryType())


@F.pandas_udf(BinaryType())
def wav_of_pcm(pcm: pd.Series, rate: pd.Series) -> pd.Series:
    """WAV files of 16-bit PCM bytes; odd lengths and rates outside 8 to 48 kHz are errors."""

    def one(data: bytes, r: int) -> bytes:
        if not 8000 <= r <= 48000 or len(data) % 2:
            raise ValueError("PCM needs whole 16-bit samples at 8 to 48 kHz")
        return wav(np.frombuffer(data, "<i2") / 32767, r)

    return pd.Series([one(d, r) for d, r in zip(pcm, rate, strict=True)])


def regions(samples: np.ndarray, rate: int) -> list[tuple[int, int]]:
    """Voiced regions in frames. Silence ends a region, so does its greatest length; short ones are dropped unless cut for length."""
    frame = max(1, round(FRAME * rate))
    n = -(-len(samples) // frame)
    if not n:
        return []
    flat = np.zeros(n * frame, dtype=np.float32)
    flat[: len(samples)] = samples
    sums = (flat * flat).reshape(n, frame).sum(axis=1)
    sizes = np.full(n, frame, dtype=np.float32)
    sizes[-1] = len(samples) - (n - 1) * frame
    energy = np.sqrt((sums / sizes).astype(np.float64) + 1e-12).astype(np.float32)
    voiced = np.flatnonzero(energy >= max(0.003, 2.5 * float(np.percentile(energy, 20)), 0.08 * float(np.percentile(energy, 95))))
    quiet, most, least = (max(1, round(s / FRAME)) for s in (SILENCE, LONGEST, SHORTEST))
    out: list[tuple[int, int]] = []
    begin, last = -1, -1
    # walk over voiced frames only; None stands for the end of the recording
    for at in [*voiced.tolist(), None]:
        while begin >= 0:
            silent_from = last + 1
            closes = silent_from + quiet - 1  # the frame that makes the silence long enough
            cut = begin + most - 1  # the frame that makes the region too long
            until = n - 1 if at is None else at - 1  # silent frames up to here
            if cut <= until and cut < closes:
                out.append((begin, cut + 1))
                begin = -1
            elif closes <= until:
                if silent_from - begin >= least:
                    out.append((begin, silent_from))
                begin = -1
            else:
                break
        if at is None:
            if begin >= 0 and n - begin >= least:
                out.append((begin, n))
            break
        if begin < 0:
            begin = at
        last = at
        if at - begin + 1 >= most:
            out.append((begin, at + 1))
            begin = -1
    return out


def segments(recordings: DataFrame, key: str = "recording", samples: str = "samples", rate: str = "rate", target: int | None = None) -> DataFrame:
    """Rows (key, segment, start, end in seconds, wav) of the voiced regions of each recording, padded; one recording at a time, at the target rate if one is given."""
    schema = StructType([recordings.schema[key], *StructType.fromDDL("segment string, start double, end double, wav binary").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in arrow]
            for k, s, r in zip(batch.column(key).to_pylist(), _lists(batch.column(samples)), batch.column(rate).to_pylist(), strict=True):
                if s is None or r is None:
                    continue
                if target and target != r:
                    s, r = resampled(s, r, target), target
                frame, pad = max(1, round(FRAME * r)), round(PAD * r)
                for i, (a, b) in enumerate(regions(s, r)):
                    a, b = max(0, a * frame - pad), min(len(s), b * frame + pad)
                    for to, x in zip(rows, (k, f"{k}#segment-{i:04d}", a / r, b / r, wav(s[a:b], r)), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(rows, arrow, strict=True)], schema=arrow)

    return recordings.select(key, samples, rate).mapInArrow(run, schema)


def gap_segments(events: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """Numbered runs of events of a key that no gap of ``gap`` seconds or more parts: segment, start, end, n."""
    w = Window.partitionBy(key).orderBy(at)
    marked = events.withColumn("fresh", F.when(F.coalesce(F.col(at) - F.lag(at).over(w) >= gap, F.lit(True)), 1).otherwise(0))
    numbered = marked.withColumn("segment", F.sum("fresh").over(w) - 1)
    return numbered.groupBy(key, "segment").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n"))


def gap_step(gap: float, most: float) -> Step:
    """A step on events of key and at: the number of the segment that each belongs to. A gap ends a segment, so does its greatest length."""

    def step(state: dict | None, event: dict) -> tuple[dict, dict]:
        at = event["at"]
        if state is None:
            now = {"segment": 0, "start": at, "last": at}
        elif at - state["last"] >= gap or at - state["start"] >= most:
            now = {"segment": state["segment"] + 1, "start": at, "last": at}
        else:
            now = state | {"last": at}
        return now, {"key": event["key"], "at": at, "segment": now["segment"]}

    return step


GAPS = "key long, at long, segment long"


def labelled(events: DataFrame, gap: float, most: float) -> DataFrame:
    """The segment of every event (key, at)."""
    return fold(events, "key", ["at"], gap_step(gap, most), GAPS)


def labelled_stream(events: DataFrame, gap: float, most: float, number: str, idle: int | None = None) -> DataFrame:
    """As ``labelled``, for a stream whose ``number`` counts a key's events from 1 in the order of time."""
    return fold_stream(events, "key", number, gap_step(gap, most), GAPS, idle=idle)


def measured(labels: DataFrame) -> DataFrame:
    """Segments of labelled events: key, segment, start, end, n."""
    return labels.groupBy("key", "segment").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, key: str, at: str, gap: str, delay: str) -> DataFrame:
    """Runs of events that no gap parts, in batch or as a stream that gives a run once the watermark has passed its gap: start, end, n.

    In a stream, rows that come more than ``delay`` after later ones may find their run given already; Spark then drops
    them. State holds the runs that are open.
    """
    runs = events.withWatermark(at, delay).groupBy(key, F.session_window(at, gap).alias("run"))
    return runs.agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n")).drop("run")
