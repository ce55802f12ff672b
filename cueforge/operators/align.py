"""Merging cues and aligning two tracks by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.operators.scan import islands, nearest, records


def merge_same_begin(df: DataFrame, track: str = "track_id", order: str = "pos", sep: str = " ") -> DataFrame:
    """Neighbouring cues of equal begin become one (gaps and islands): texts joined, the latest end.

    Rows (track, pos, begin_ms, end_ms, text); pos is that of the first cue. Empty texts are skipped. A track may be larger than a task.
    """
    marked = islands(df, track, [order], "begin_ms", "_island")
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda x: x["t"])
    merged = marked.groupBy(track, "_island").agg(F.min(order).alias(order), F.first("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"), texts.alias("_texts"))
    return merged.select(track, order, "begin_ms", "end_ms", F.array_join(F.filter("_texts", lambda t: t != ""), sep).alias("text"))


def align_tracks(source: DataFrame, other: DataFrame, track: str = "track_id", order: str = "pos", bin_ms: int = 60_000, wide: int = 1024, default: str = "N/A") -> DataFrame:
    """``source`` with ``match``: the text of the other track's cue that belongs to each cue.

    The first other cue (by begin, then ``order``) that begins inside the closed interval wins, else the
    first that overlaps it, else ``default``. The former is the next one that begins at or after a cue's begin; the latter the first that ends there or
    later, which is one that ends later than all before it. Both are looked up along the track, in segments of ``wide`` times ``bin_ms``: the
    work follows the cues, whatever their lengths and overlaps.
    """
    span = bin_ms * wide
    o = other.select(track, F.col("begin_ms").alias("_at"), F.col("begin_ms").alias("ob"), F.col(order).alias("o_pos"), F.col("end_ms").alias("oe"), F.col("text").alias("match")).where("ob is not null")
    last = records(o, track, ["ob", "o_pos", "match"], "oe", span).withColumn("_at", F.col("oe"))
    a = source.withColumn("_at", F.col("begin_ms"))
    met = nearest(nearest(a, o, track, "_at", ["o_pos", "match"], "_next", True, span), last, track, "_at", ["ob"], "_over", True, span)
    match = F.when(F.col("_next.ob") <= F.col("end_ms"), F.col("_next.match")).when(F.col("_over.ob") <= F.col("end_ms"), F.col("_over.match"))
    return met.withColumn("match", F.coalesce(match, F.lit(default))).drop("_at", "_next", "_over")
