"""Fingerprints of frames and sound, and the likeness of two media."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let

HASH = "struct<mean: double, bits: string>"


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(values)


def average_hash(pixels: Column) -> Column:
    """A frame's mean level (of 255, 6 decimals) and a bit for each pixel at or above it; null for no pixels."""

    def bits(m):
        return F.struct(F.bround(m / 255, 6).alias("mean"), F.array_join(F.transform(pixels, lambda x: F.when(x >= m, "1").otherwise("0")), "").alias("bits"))

    return F.when(F.size(pixels) > 0, let(mean(pixels), bits))


def frame_similarity(a: Column, b: Column) -> Column:
    """Of two hashes: 0.8 of the share of equal bits and 0.2 of nearness of level; null where lengths differ."""
    n = F.length(a["bits"])
    equal = F.size(F.filter(F.zip_with(F.split(a["bits"], ""), F.split(b["bits"], ""), lambda x, y: x == y), lambda e: e))
    level = F.greatest(F.lit(0.0), 1 - F.abs(a["mean"] - b["mean"]) / 0.25)
    return F.when((n > 0) & (n == F.length(b["bits"])), 0.8 * equal / n + 0.2 * level)


def visual_similarity(left: Column, right: Column) -> Column:
    """The mean over samples; 0 where the samples do not pair."""
    scores = F.zip_with(left, right, frame_similarity)
    ok = (F.size(left) > 0) & (F.size(left) == F.size(right)) & ~F.exists(scores, lambda s: s.isNull())
    return F.when(F.coalesce(ok, F.lit(False)), mean(scores)).otherwise(0.0)


def audio_features(samples: Column) -> Column:
    """Mean level, root mean square and rate of sign changes of samples in -1..1; zeros for fewer than two."""
    n = F.size(samples)
    squares = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x)
    turns = F.zip_with(F.slice(samples, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(samples, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: ((x < 0) != (y < 0)).cast("int"))
    crossings = F.aggregate(turns, F.lit(0), lambda a, x: a + x)
    some = n >= 2
    return F.struct(
        F.when(some, mean(F.transform(samples, F.abs))).otherwise(0.0).alias("mean_abs"),
        F.when(some, F.sqrt(squares / n)).otherwise(0.0).alias("rms"),
        F.when(some, crossings / n).otherwise(0.0).alias("crossings"),
    )


def audio_similarity(left: Column, right: Column) -> Column:
    """The mean over samples of how near each feature is, relative to the larger; 0 where the samples do not pair."""

    def near(a, b):
        return F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-6)))

    one = F.zip_with(left, right, lambda a, b: (near(a["mean_abs"], b["mean_abs"]) + near(a["rms"], b["rms"]) + near(a["crossings"], b["crossings"])) / 3)
    return F.when(F.coalesce((F.size(left) > 0) & (F.size(left) == F.size(right)), F.lit(False)), mean(one)).otherwise(0.0)


@dataclass(frozen=True)
class IdentityRule:
    seconds: float = 1.5
    share: float = 0.005
    visual: float = 0.91
    audio: float = 0.82
    probable: float = 0.90


def identity_score(a: str, b: str, rule: IdentityRule = IdentityRule()) -> Column:
    """The likeness of media in struct columns a and b, 0 behind a closed gate: durations, then dimensions or kind, frames, sound.

    A side without sound adds 0.10 without a comparison, and sound alone can't reach `probable`: rules kept as they are.
    """
    x, y = (lambda k: F.col(f"{a}.{k}")), (lambda k: F.col(f"{b}.{k}"))
    off = lambda c: F.coalesce(c, F.lit(False))
    near = off(F.abs(x("duration_seconds") - y("duration_seconds")) <= F.greatest(F.lit(rule.seconds), x("duration_seconds") * rule.share))
    same_size = off((x("width") > 0) & (x("height") > 0) & (x("width") == y("width")) & (x("height") == y("height")))
    video = off(x("media_type") == "video")
    other_kind = video & ~off(y("media_type") == "video") & ~same_size
    v, s = visual_similarity(x("video_samples"), y("video_samples")), audio_similarity(x("audio_samples"), y("audio_samples"))
    both = off((F.size(x("audio_samples")) > 0) & (F.size(y("audio_samples")) > 0))
    shut = ~near | other_kind | (video & (v < rule.visual)) | (both & (s < rule.audio))
    score = (
        0.25
        + F.when(same_size, 0.15).otherwise(0.0)
        + F.when(video, 0.40 * v).otherwise(0.0)
        + F.when(both, 0.20 * s).otherwise(0.10)
        + F.when(off((x("audio_channels") > 0) & (x("audio_channels") == y("audio_channels"))), 0.05).otherwise(0.0)
        + F.when(off((x("audio_sample_rate") > 0) & (x("audio_sample_rate") == y("audio_sample_rate"))), 0.05).otherwise(0.0)
    )
    return F.when(shut, 0.0).otherwise(F.least(F.lit(1.0), score))


def peak_normalised(samples: Column) -> Column:
    """Samples divided by their peak if it is above 1, cut to -1..1."""
    peak = F.coalesce(F.array_max(F.transform(samples, F.abs)), F.lit(0.0))
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x))
    return let(peak, lambda p: F.transform(samples, lambda x: clip(F.when(p > 1, x / p).otherwise(x))))


def pcm16(samples: Column) -> Column:
    return F.transform(samples, lambda x: F.bround(x * 32767, 0).cast("int"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def resampled(samples: pd.Series, rate: pd.Series, target: pd.Series) -> pd.Series:
    """Linear interpolation to the target rate."""

    def one(x, a, b):
        n = max(1, round(len(x) * b / a)) if len(x) else 0
        return np.interp(np.arange(n) * (a / b), np.arange(len(x)), x) if n else np.zeros(0)

    return pd.Series([None if x is None else one(np.asarray(x, float), a, b) for x, a, b in zip(samples, rate, target, strict=True)])
