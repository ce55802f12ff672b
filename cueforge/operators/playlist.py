"""Lengths of tracks and the order in which clips are played."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.operators.scan import running


def track_extent(df: DataFrame, track: str = "track_id", order: str = "line_no", margin_s: int = 30) -> DataFrame:
    """Rows (track, duration_ms, horizon_s): the latest end; the last line's whole second plus a margin."""
    last = F.floor(F.max_by("begin_ms", order) / 1000).cast("long") + margin_s
    return df.groupBy(track).agg(F.max("end_ms").alias("duration_ms"), last.alias("horizon_s"))


def playlist(base: DataFrame, clips: DataFrame, track: str = "track_id", order: str = "line_no", silence_ms: int = 1000) -> DataFrame:
    """Rows (track, item_no, line_no, kind, cut_ms, length_ms, start_ms): translation, original and slow original of every line.

    ``clips(track, line_no, clip_ms)`` are the spoken translations; a line without one has a silence. The
    original is cut at its begin; at half speed it lasts twice as long. start_ms is the place in the list. A track may be larger than a task.
    """
    length = F.greatest(F.col("end_ms") - F.col("begin_ms"), F.lit(0))
    rows = base.select(track, order, F.col("begin_ms").alias("cut_ms"), length.alias("_len")).join(clips.select(track, order, "clip_ms"), [track, order], "left")
    spoken = F.coalesce("clip_ms", F.lit(silence_ms)).cast("long")
    placed = running(rows, track, [order], {"_from": spoken + F.col("_len") * 3, "_line": F.lit(1)}, inclusive=False)
    item = lambda kind, cut, n, before: F.struct(kind.alias("kind"), cut.alias("cut_ms"), n.cast("long").alias("length_ms"), before.cast("long").alias("before"))
    said = item(F.when(F.col("clip_ms").isNull(), "silence").otherwise("translation"), F.lit(None).cast("long"), spoken, F.lit(0))
    items = F.array(said, item(F.lit("original"), F.col("cut_ms"), F.col("_len"), spoken), item(F.lit("slow"), F.col("cut_ms"), F.col("_len") * 2, spoken + F.col("_len")))
    each = placed.select(track, order, "_from", "_line", F.posexplode(items).alias("_k", "x"))
    return each.select(track, (F.col("_line") * 3 + F.col("_k") + 1).cast("int").alias("item_no"), order, "x.kind", "x.cut_ms", "x.length_ms", (F.col("_from") + F.col("x.before")).alias("start_ms"))
