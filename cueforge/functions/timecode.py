"""Time columns. Canonical time is a bigint of milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def srt_to_ms(c: Column | str, lenient: bool = False) -> Column:
    """``HH:MM:SS,mmm`` to milliseconds; null if malformed.

    ``lenient`` also takes ``MM:SS,mmm`` and bare seconds, a dot for the comma, and gives 0 for anything else.
    """
    text = F.trim(_col(c))
    part = lambda k: F.regexp_extract(text, r"^(\d+):(\d+):(\d+)[,](\d{1,3})$", k)
    whole = (F.try_to_number(F.lpad(part(1), 9, "0"), F.lit("999999999")).cast("long") * 3600 + part(2).try_cast("long") * 60 + part(3).try_cast("long")) * 1000 + F.rpad(part(4), 3, "0").try_cast("long")
    strict = F.when(text.rlike(r"^\d{1,9}:\d{1,9}:\d{1,9},\d{1,3}$"), whole)
    if not lenient:
        return strict
    bits = F.split(F.replace(text, F.lit(","), F.lit(".")), ":")
    secs = F.element_at(bits, -1).try_cast("decimal(18,3)")
    mins = F.when(F.size(bits) > 1, F.element_at(bits, -2).try_cast("long")).otherwise(F.lit(0))
    hours = F.when(F.size(bits) > 2, F.element_at(bits, -3).try_cast("long")).otherwise(F.lit(0))
    return F.coalesce(F.when(F.size(bits) <= 3, ((hours * 3600 + mins * 60) * 1000 + secs * 1000).cast("long")), F.lit(0).cast("long"))


def ms_to_srt(c: Column | str) -> Column:
    """Milliseconds to ``HH:MM:SS,mmm``; hours may have more than two digits."""
    ms = _col(c)
    hours = F.floor(ms / 3_600_000).cast("string")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def vtt_to_ms(c: Column | str, truncate: bool = False, hours: bool = True) -> Column:
    """``MM:SS.mmm`` or bare seconds to milliseconds, 0 for anything else.

    ``truncate`` cuts the milliseconds of the double, as the reader it follows does (``00:02.300`` is
    2299). ``hours`` also accepts ``HH:MM:SS.mmm`` and ignores cue settings after the time.
    """
    text = F.trim(_col(c))
    if hours:
        text = F.regexp_extract(text, r"^(\S*)", 1)
    bits = F.split(text, ":")
    head = F.when(F.size(bits) == 2, bits[0].try_cast("long") * 60).when(F.size(bits) == 1, F.lit(0).cast("long"))
    if hours:
        head = F.when(F.size(bits) == 3, bits[0].try_cast("long") * 3600 + F.get(bits, F.lit(1)).try_cast("long") * 60).otherwise(head)
    last = F.element_at(bits, -1)
    if truncate:
        s = last.try_cast("double")
        tail = F.floor(s) * 1000 + ((s - F.floor(s)) * 1000).cast("int")
    else:
        tail = (last.try_cast("decimal(18,3)") * 1000).cast("long")
    return F.coalesce((head * 1000 + tail).cast("long"), F.lit(0).cast("long"))


def secs_to_ms(c: Column | str, require_suffix: bool = False) -> Column:
    """``72.943s`` to milliseconds (half up at the third decimal); null if it isn't such a time."""
    shape = r"^\s*(\d+(?:\.\d*)?)s\s*$" if require_suffix else r"^\s*(\d+(?:\.\d*)?)s?\s*$"
    found = F.nullif(F.regexp_extract(_col(c), shape, 1), F.lit(""))
    return (F.regexp_replace(found, r"\.$", "").try_cast("decimal(18,3)") * 1000).cast("long")


def ms_to_secs(c: Column | str) -> Column:
    """Milliseconds to ``72.943s``, by whole numbers only."""
    ms = _col(c)
    return F.concat(F.when(ms < 0, F.lit("-")).otherwise(F.lit("")), F.floor(F.abs(ms) / 1000).cast("string"), F.lit("."), F.lpad((F.abs(ms) % 1000).cast("string"), 3, "0"), F.lit("s"))


def ticks_to_secs(c: Column | str, rate: Column | str | int) -> Column:
    """``<digits>t`` divided by the tick rate as ``x.xxxs``, half up; other values stay; null if the rate is not positive."""
    text = _col(c)
    per = F.lit(rate) if isinstance(rate, int) else _col(rate)
    ticks = F.regexp_extract(text, r"^(\d{1,20})t$", 1).try_cast("decimal(20,0)")
    ms = F.round(ticks * 1000 / F.nullif(per.cast("decimal(12,0)"), F.lit(0).cast("decimal(12,0)")), 0).cast("long")
    return F.when(ticks.isNull(), text).when(per > 0, ms_to_secs(ms))


def shifted(c: Column | str, delta_ms: int) -> Column:
    """Time moved by ``delta_ms``, not below 0, wrapping at a day."""
    return F.greatest(_col(c) + F.lit(delta_ms), F.lit(0)) % F.lit(DAY_MS)


def seek_second(c: Column | str) -> Column:
    """Second at which to look up a picture: beyond 250 s the correction grows with the time (half even)."""
    t = _col(c).cast("double")
    return F.when(t > 250, t + F.bround(t * 0.001749577141105422 + 0.18668641727612567, 0)).otherwise(t)


def seek_frame(c: Column | str, fps: Column | float) -> Column:
    """Frame number at the corrected second."""
    return F.floor(seek_second(c) * (F.lit(fps) if not isinstance(fps, Column) else fps)).cast("long")
