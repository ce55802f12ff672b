"""Frames of videos and the captions on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds of a track that are captioned together.
_BLOCK = 1 << 10


def _half_even(c: str) -> Column:
    return F.bround(F.col(c).cast("decimal(20,3)") / 1000, 0).cast("long")


def cue_seconds(base: DataFrame, policy: str, wins: str = "last", track: str = "track_id", order: str = "line_no") -> DataFrame:
    """One caption for each (track, second): ``begin`` keys by the rounded begin, ``span`` by every second from there to the rounded end, ``onebased`` by the whole second plus one, ``floor`` by the whole second."""
    keys = {
        "begin": F.array(_half_even("begin_ms")),
        "span": F.when(_half_even("end_ms") >= _half_even("begin_ms"), F.sequence(_half_even("begin_ms"), _half_even("end_ms"))),
        "onebased": F.array(F.floor(F.col("begin_ms") / 1000) + 1),
        "floor": F.array(F.floor(F.col("begin_ms") / 1000)),
    }
    each = base.select(track, F.explode(keys[policy]).alias("second"), F.col(order).alias("_o"), F.struct(*[c for c in base.columns if c != track]).alias("cue"))
    pick = F.max_by if wins == "last" else F.min_by
    return each.groupBy(track, "second").agg(pick("cue", "_o").alias("cue"))


def attach_cue_to_frame(frames: DataFrame, base: DataFrame, policy: str = "begin", wins: str = "last", track: str = "track_id", order: str = "line_no") -> DataFrame:
    """``frames`` (track, second, …) with the struct ``cue`` of their second, null without one."""
    if policy == "span":
        return _attach_spans(frames, base, wins, track, order)
    return frames.join(cue_seconds(base, policy, wins, track, order), [track, "second"], "left")


def _attach_spans(frames: DataFrame, base: DataFrame, wins: str, track: str, order: str) -> DataFrame:
    """Cues and frames meet by blocks of seconds of a track, where each cue is laid on its seconds in order: no row a second is shuffled."""
    lo, hi = _half_even("begin_ms"), _half_even("end_ms")
    block = lambda c: F.floor(c / _BLOCK).cast("long")
    whole = base.where((hi >= lo) & F.col(track).isNotNull() & F.col(order).isNotNull())
    cue = F.struct(*[c for c in base.columns if c != track])
    laid = whole.select(F.col(track).cast("string").alias("_t"), lo.alias("_lo"), hi.alias("_hi"), F.col(order).alias("_o"), cue.alias("cue"), F.explode(F.sequence(block(lo), block(hi))).alias("_b"))
    columns = [track, "second", *[c for c in frames.columns if c not in (track, "second")]]
    second = F.col("second").cast("long")
    asked = frames.select(F.col(track).cast("string").alias("_t"), second.alias("_lo"), second.alias("_hi"), block(second).alias("_b"), F.struct(*columns).alias("_frame"))
    both = asked.unionByName(laid, allowMissingColumns=True).repartition("_t", "_b")
    turn = F.asc if wins == "last" else F.desc
    rows = both.sortWithinPartitions("_t", "_b", F.col("_frame").isNotNull(), turn("_o")).select("_t", "_b", "_lo", "_hi", "cue", "_frame")
    made = T.StructType([f for f in rows.schema.fields if f.name in ("cue", "_frame")])
    return rows.mapInArrow(_laid_on_seconds, made).select(*[F.col("_frame")[c].alias(c) for c in columns], "cue")


def _laid_on_seconds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frames of sorted blocks, each with the cue that was laid last on its second."""
    key, on, held = None, np.full(_BLOCK, -1), None
    for batch in batches:
        if not batch.num_rows:
            continue
        cues, asked = batch.column("cue"), batch.column("_frame")
        # Of the rows before this batch only cues that still lie on a second are kept.
        before = 0 if held is None else len(held)
        source = cues if held is None else pa.concat_arrays([held, cues])
        frame = asked.is_valid().to_numpy(zero_copy_only=False).tolist()
        places, found = [], []
        for i, (t, b, lo, hi) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("_t", "_b", "_lo", "_hi")], strict=True)):
            if (t, b) != key:
                key = (t, b)
                on[:] = -1
            if frame[i]:
                places.append(i)
                found.append(-1 if b is None else int(on[lo - b * _BLOCK]))
            else:
                on[max(lo - b * _BLOCK, 0) : hi - b * _BLOCK + 1] = before + i
        if places:
            taken = np.array(found)
            yield pa.RecordBatch.from_arrays([source.take(pa.array(taken, mask=taken < 0)), asked.take(pa.array(places))], ["cue", "_frame"])
        kept, back = np.unique(on, return_inverse=True)
        kept = np.where(kept < 0, 0, kept)
        held = source.take(pa.array(kept))
        on = np.where(on < 0, -1, back)


def parse_frame_names(frames: DataFrame, name: str = "name") -> DataFrame:
    """``frames`` with second and frame of ``00072_1.png`` or ``72.png`` (frame 0); null for other names."""
    second, frame = (F.regexp_extract(name, r"^(\d{1,9})(?:_(\d{1,9}))?\.png$", k) for k in (1, 2))
    return frames.withColumns({"second": second.try_cast("int"), "frame": F.when(second != "", F.coalesce(frame.try_cast("int"), F.lit(0)))})


def sort_frames(frames: DataFrame, track: str = "track_id", name: str = "name") -> DataFrame:
    """By track, then (second, frame) as numbers; other names last, by name."""
    return parse_frame_names(frames, name).orderBy(track, F.col("second").isNull(), "second", "frame", name)


def frames_for_video(videos: DataFrame, per_second: int | None = None, track: str = "track_id") -> DataFrame:
    """Rows (track, i, second, frame) of ``videos(track, n_frames, fps)``.

    All frames, or with ``per_second`` the first frame at or after each of so many places a second (fps at
    least that many); a video under a second gives its first frame only.
    """
    v = videos.where("n_frames > 0 and fps > 0")
    if per_second is None:
        e = v.select(track, "fps", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1)).alias("i"))
        return e.select(track, "i", (F.floor(F.col("i") / F.col("fps")) + 1).cast("long").alias("second"), (F.floor(F.col("i") % F.col("fps")) + 1).cast("long").alias("frame"))
    whole = F.floor(F.col("n_frames") / F.col("fps")).cast("long")
    first = v.where(whole < 1).select(track, F.lit(0).cast("long").alias("i"), F.lit(1).cast("long").alias("second"), F.lit(1).cast("long").alias("frame"))
    e = v.where(whole >= 1).select(track, "fps", "n_frames", F.explode(F.sequence(F.lit(1).cast("long"), whole)).alias("second"))
    e = e.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(per_second).cast("long"))).alias("frame"))
    place = (F.col("second") - 1) * F.col("fps") + (F.col("frame") - 1) * F.col("fps") / per_second
    return first.union(e.withColumn("i", F.ceil(place).cast("long")).where("i < n_frames").select(track, "i", "second", "frame"))


def frame_artifacts(frames: DataFrame, base: DataFrame, pairs: str = "pairs", track: str = "track_id", policy: str = "begin") -> DataFrame:
    """Rows (track, name, artifact): ``a``, ``ba``, ``bb`` … for each gloss, and ``c``; ``resize`` for a frame without caption."""
    joined = attach_cue_to_frame(parse_frame_names(frames), base, policy, track=track)
    letters = F.transform(F.col(f"cue.{pairs}"), lambda _, i: F.concat(F.lit("b"), F.decode(F.unhex(F.lpad(F.hex(i + 97), 4, "0")), "UTF-16BE")))
    kinds = F.when(F.col("cue").isNull(), F.array(F.lit("resize"))).otherwise(F.concat(F.array(F.lit("a")), F.coalesce(letters, F.array().cast("array<string>")), F.array(F.lit("c"))))
    return joined.select(track, "name", F.posexplode(kinds).alias("artifact_no", "artifact"))


def next_index(files: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """Rows (folder, next_index): one more than the greatest whole-number file stem, 1 without any."""
    stem = F.regexp_extract(name, r"^(\d{1,18})\.[^.]*$", 1).try_cast("long")
    return files.groupBy(folder).agg((F.coalesce(F.max(stem), F.lit(0)) + 1).alias("next_index"))
