"""Incremental appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resume_filter(new: DataFrame, existing: DataFrame, resume_from_ms: int | None = None, track: str = "track_id", order: str = "line_no") -> DataFrame:
    """Rows to append: begin not in ``existing`` and after its last line's begin; ``idx`` goes on from its greatest.

    With ``resume_from_ms`` only existing rows before it count, and everything from it on is made anew.
    """
    if resume_from_ms is not None:
        existing = existing.where(F.col("begin_ms") < resume_from_ms)
        new = new.where(F.col("begin_ms") >= resume_from_ms)
    last = existing.groupBy(track).agg(F.max_by("begin_ms", order).alias("_last"), F.max("idx").alias("_idx"))
    fresh = new.drop("idx").join(existing.select(track, "begin_ms").distinct(), [track, "begin_ms"], "left_anti").join(last, track, "left")
    fresh = fresh.where(F.col("_last").isNull() | (F.col("begin_ms") > F.col("_last")))
    w = Window.partitionBy(track).orderBy("begin_ms", order)
    return fresh.withColumn("idx", (F.coalesce("_idx", F.lit(0)) + F.row_number().over(w)).cast("int")).drop("_last", "_idx")


def resume_lines(new: DataFrame, existing: DataFrame, text: str = "text") -> DataFrame:
    """Text rows that are not there yet."""
    return new.join(existing.select(text).distinct(), text, "left_anti").select(*new.columns)
