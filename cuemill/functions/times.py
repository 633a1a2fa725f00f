"""Cue times, sample positions and retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(c: Column) -> Column:
    """HH:MM:SS.mmm (or a comma) as seconds; null unless there are three numeric parts."""
    parts = F.split(F.replace(F.trim(c), F.lit(","), F.lit(".")), ":")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 3, number(1) * 3600 + number(2) * 60 + number(3))


def format_time(seconds: Column, carry: bool = True) -> Column:
    """Seconds as HH:MM:SS.mmm; null for negative or not finite.

    With carry the time is rounded to milliseconds first, so 59.9996 is 00:01:00.000; without it the seconds are rounded on
    their own and may read 60.000.
    """
    s = seconds.cast("double")
    if carry:
        ms = F.bround(s * 1000, 0).cast("long")
        out = F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    else:
        out = F.format_string("%02d:%02d:%06.3f", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return F.when(finite(s) & (s >= 0), out)


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite; NaN compares above every number."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def sample_positions(duration: Column) -> Column:
    """Where to sample a medium: tenths of what lies between margins of 5 %, at most 2 s; the middle of a very short one."""
    d = duration.cast("double")
    margin = F.least(F.lit(2.0), d * 0.05)
    usable = d - 2 * margin
    spread = F.array(*[margin + usable * r for r in (0.10, 0.30, 0.50, 0.70, 0.90)])
    return F.when(d <= 0, F.array(F.lit(0.0))).when(d <= margin * 2, F.array(d / 2)).otherwise(spread)


def backoff(attempt: Column, base: float = 1.0, cap: float = 30.0) -> Column:
    """The delay before a retry, without jitter: base doubled for each attempt after the first, at most cap."""
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt - 1))


def stretch_factors(ratio: Column) -> Column:
    """A speed-up as a chain of factors: 2.0 as often as it goes in, then the rest."""
    twos = F.greatest(F.lit(0), F.ceil(F.log2(ratio) - 1e-9) - 1).cast("int")
    rest = ratio / F.pow(F.lit(2.0), twos)
    return F.concat(F.array_repeat(F.lit(2.0), twos), F.array(rest))
