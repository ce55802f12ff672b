"""Re-timing, time windows and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueforge.functions.timecode import shifted
from cueforge.operators.scan import nearest, next_value, running


def adjust_end_times(lines: DataFrame, track: str = "track_id", order: str = "line_no", extend_ms: int = 60_000, gap_ms: int = 1) -> DataFrame:
    """``lines`` with end_ms extended up to just before the next physical line.

    A next line that is absent or has no time lets the whole extension stand; an end that isn't
    after the begin becomes begin + ``gap_ms``. Lines without a time are dropped after the look ahead. A track may be larger than a task.
    """
    lines, columns = next_value(lines, track, [order], "begin_ms", "_after"), lines.columns
    after = F.col("_after")
    end = F.least(F.col("end_ms") + extend_ms, F.coalesce(after - gap_ms, F.col("end_ms") + extend_ms))
    moved = lines.withColumn("end_ms", F.when(end <= F.col("begin_ms"), F.col("begin_ms") + gap_ms).otherwise(end))
    return moved.where("begin_ms is not null and end_ms is not null").select(*columns)


def shift_times(df: DataFrame, delta_ms: int) -> DataFrame:
    """Both times moved, not below 0, wrapping at a day."""
    return df.withColumns({c: shifted(c, delta_ms) for c in ("begin_ms", "end_ms")})


def first_window(df: DataFrame, limit_ms: int = 60_000, track: str = "track_id", order: str = "pos", clamp: bool = True) -> DataFrame:
    """Cues in file order up to the first that begins at ``limit_ms`` or later, ends clamped, renumbered as ``idx``; a track may be larger than a task."""
    past = F.when(F.col("begin_ms") >= limit_ms, 1).otherwise(0)
    kept = running(df, track, [order], {"_past": past, "_idx": F.lit(1)}).where("_past = 0")
    if not clamp:
        return kept.select(*df.columns)
    return kept.withColumn("end_ms", F.least("end_ms", F.lit(limit_ms))).withColumn("idx", F.col("_idx").cast("int")).drop("_past", "_idx")


def first_window_base(df: DataFrame, limit_ms: int = 60_000, track: str = "track_id", order: str = "line_no") -> DataFrame:
    """The same for base rows: neither clamped nor renumbered."""
    return first_window(df, limit_ms, track, order, clamp=False)


def chunk_fixed(cues: DataFrame, durations: DataFrame, chunk_ms: int = 30_000, track: str = "track_id", order: str = "pos", empty: bool = True) -> DataFrame:
    """Every chunk of ``durations(track, duration_ms)`` with its cues: chunk_no, chunk_start_ms, chunk_end_ms, chunk_idx and the cue's columns.

    A cue is in the chunk that holds its begin; a chunk without cues has one row of null cue
    columns; cues at or beyond the duration are dropped. Without ``empty`` only chunks with cues are given: the work then
    follows the cues and not the lengths of the tracks.
    """
    w = Window.partitionBy(track, "chunk_no").orderBy(order)
    if not empty:
        known = durations.where("duration_ms > 0").select(track, "duration_ms")
        met = cues.withColumn("chunk_no", F.floor(F.col("begin_ms") / chunk_ms)).where("chunk_no >= 0").join(known, track).where("begin_ms < duration_ms")
        start, end = F.col("chunk_no") * chunk_ms, F.least((F.col("chunk_no") + 1) * chunk_ms, F.col("duration_ms"))
        rest = [c for c in cues.columns if c != track]
        return met.select(track, "chunk_no", start.alias("chunk_start_ms"), end.alias("chunk_end_ms"), *rest).withColumn("chunk_idx", F.row_number().over(w))
    last = F.greatest(F.ceil(F.col("duration_ms") / chunk_ms) - 1, F.lit(0))
    chunks = durations.where("duration_ms > 0").select(track, "duration_ms", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_no"))
    chunks = chunks.select(track, "chunk_no", (F.col("chunk_no") * chunk_ms).alias("chunk_start_ms"), F.least((F.col("chunk_no") + 1) * chunk_ms, F.col("duration_ms")).alias("chunk_end_ms"))
    placed = cues.withColumns({"_track": F.col(track), "_no": F.floor(F.col("begin_ms") / chunk_ms)}).drop(track)
    met = (F.col(track) == F.col("_track")) & (F.col("chunk_no") == F.col("_no")) & (F.col("begin_ms") < F.col("chunk_end_ms"))
    joined = chunks.join(placed, met, "left").drop("_track", "_no")
    return joined.withColumn("chunk_idx", F.when(F.col("begin_ms").isNotNull(), F.row_number().over(w)))


def rebase_chunk_times(df: DataFrame, min_ms: int | None = None, legacy_double: bool = False) -> DataFrame:
    """Times relative to ``chunk_start_ms``; with ``min_ms`` begin is at least 0 and end at least begin + ``min_ms``.

    ``legacy_double`` subtracts the chunk's start twice, as one of the tools that this replaces did.
    """
    off = F.col("chunk_start_ms") * (2 if legacy_double else 1)
    begin, length = F.col("begin_ms") - off, F.col("end_ms") - F.col("begin_ms")
    if min_ms is None:
        return df.withColumns({"begin_ms": begin, "end_ms": begin + length})
    low = F.greatest(begin, F.lit(0))
    return df.withColumns({"begin_ms": low, "end_ms": F.greatest(begin + length, low + min_ms)})


def assign_to_chunks(cues: DataFrame, chunks: DataFrame, track: str = "track_id", bin_ms: int = 60_000) -> DataFrame:
    """``cues`` with chunk_no and chunk_start_ms of the chunk [start, end) that holds their begin; others drop.

    ``chunks(track, chunk_no, duration_ms)`` follow each other, with lengths of 0 or more; a cue takes the last chunk that starts at or
    before its begin, so each cue and each chunk is shuffled once whatever their lengths. A track is cut in segments of 1,024 ``bin_ms``.
    """
    w = Window.partitionBy(track).orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = chunks.withColumn("chunk_end_ms", F.sum("duration_ms").over(w)).withColumn("chunk_start_ms", F.col("chunk_end_ms") - F.col("duration_ms")).where("duration_ms > 0")
    marks = placed.select(track, F.col("chunk_start_ms").alias("_at"), "chunk_no", "chunk_start_ms", "chunk_end_ms")
    met = nearest(cues.withColumn("_at", F.col("begin_ms")), marks, track, "_at", ["chunk_no"], "_chunk", span=1024 * bin_ms)
    kept = met.where(F.col("begin_ms") < F.col("_chunk.chunk_end_ms"))
    return kept.select(track, *[c for c in cues.columns if c != track], *[f"_chunk.{c}" for c in ("chunk_no", "chunk_start_ms", "chunk_end_ms")])
