"""Timecodes and the frame grid, in exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_srt(ms: Column) -> Column:
    """``HH:MM:SS,mmm``; negative times are 0, hours do not wrap."""
    t = F.greatest(ms, F.lit(0)).cast("long")
    part = lambda of, most: F.lpad((F.floor(t / of) % most).cast("string"), 2, "0")
    h = F.floor(t / 3_600_000).cast("string")
    hours = F.when(F.length(h) < 2, F.lpad(h, 2, "0")).otherwise(h)
    return F.concat(hours, F.lit(":"), part(60_000, 60), F.lit(":"), part(1000, 60), F.lit(","), F.lpad((t % 1000).cast("string"), 3, "0"))


def to_vtt(ms: Column) -> Column:
    return F.replace(to_srt(ms), F.lit(","), F.lit("."))


def parse(timecode: Column, strict: bool = True) -> Column:
    """Milliseconds of ``HH:MM:SS,mmm``; otherwise an error, or 0 where not ``strict``."""
    pattern = r"^\s*(\d{2,}):(\d{2}):(\d{2})[,.](\d{3})\s*$"
    g = [F.regexp_extract(timecode, pattern, i).cast("long") for i in (1, 2, 3, 4)]
    value = ((g[0] * 60 + g[1]) * 60 + g[2]) * 1000 + g[3]
    bad = F.raise_error(F.concat(F.lit("not a timecode: "), timecode)).cast("long") if strict else F.lit(0).cast("long")
    return F.when(timecode.rlike(pattern), value).otherwise(bad)


def to_frame(ms: Column, num: int = 25, den: int = 1, mode: str = "nearest") -> Column:
    """The frame of a time at ``num/den`` frames a second: ``nearest``, ``floor`` or ``ceil``."""
    top, below = ms.cast("long") * num, 1000 * den
    if mode == "floor":
        return _div(top, below)
    return -_div(-top, below) if mode == "ceil" else _div(2 * top + below, 2 * below)


def from_frame(frame: Column, num: int = 25, den: int = 1) -> Column:
    return _div(2 * frame.cast("long") * 1000 * den + num, 2 * num)


def _div(a: Column, b: int) -> Column:
    """Floor division of integers, exact for any size."""
    return ((a - F.pmod(a, F.lit(b).cast("long"))) / F.lit(b)).cast("long")
