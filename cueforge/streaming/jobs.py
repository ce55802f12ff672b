"""Incremental forms of the batch work, for Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cueforge.functions.pairs import pair_words


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    """``df`` with ``ts`` as a timestamp that watermarks accept."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


#: The state store that expiring state needs (a setting of the session).
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _fresh(parts: Iterator[pd.DataFrame], mark: int | None, begin: str, order: str) -> pd.DataFrame:
    """The rows after ``mark``, the first of each begin, in order."""
    whole = pd.concat([p if mark is None else p[p[begin] > mark] for p in parts])
    return whole.sort_values([begin, order], kind="stable").drop_duplicates(begin)


class _Marks(StatefulProcessor):
    """Each track's high-water mark, forgotten after ``idle_ms`` without a new one."""

    def __init__(self, begin: str, order: str, idle_ms: int):
        self.begin, self.order, self.idle_ms = begin, order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "mark long", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        kept = _fresh(rows, self.mark.get()[0] if self.mark.exists() else None, self.begin, self.order)
        if len(kept):
            self.mark.update((int(kept[self.begin].max()),))
        yield kept

    def close(self) -> None:
        pass


def stream_new_cues(sdf: DataFrame, track: str = "track_id", begin: str = "begin_ms", order: str = "pos", idle_ms: int | None = None) -> DataFrame:
    """Cues after each track's high-water mark: one at or before the last written begin is late and skipped.

    With ``idle_ms`` a track's mark is forgotten when that long has passed since it last rose, so the state holds the active tracks only; a track that comes back
    later begins anew. That needs the session's state store to be ``ROCKSDB``. Without it every mark is kept.
    """
    if idle_ms is not None:
        return sdf.groupBy(track).transformWithStateInPandas(_Marks(begin, order, idle_ms), sdf.schema, "append", "processingTime")

    def fresh(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = _fresh(parts, state.get[0] if state.exists else None, begin, order)
        if len(kept):
            state.update((int(kept[begin].max()),))
            yield kept

    return sdf.groupBy(track).applyInPandasWithState(fresh, sdf.schema, "mark long", "append", GroupStateTimeout.NoTimeout)


def stream_align(source: DataFrame, other: DataFrame, delay: str = "1 minute", longest: str = "10 minutes", track: str = "track_id", order: str = "pos", default: str = "N/A") -> DataFrame:
    """Rows (track, order, begin_ms, end_ms, text, match) of ``align_tracks``, for two streams of cues.

    The streams meet by an interval join with watermarks of ``delay`` on both begins; a cue of the first comes out, once, when no cue of the other can
    belong to it any more. ``longest`` bounds the length of a cue of either stream and so the state; of longer ones only what lies
    within it of a begin is met. Cues later than ``delay`` are dropped; nulls in a begin or end take no part.
    """
    a = source.select(F.col(track).alias("_t"), F.col(order).alias("_p"), "begin_ms", "end_ms", "text", F.timestamp_millis("begin_ms").alias("_a")).where("begin_ms is not null and end_ms is not null").withWatermark("_a", delay)
    o = other.select(F.col(track).alias("_ot"), F.col(order).alias("_op"), F.col("begin_ms").alias("_ob"), F.col("end_ms").alias("_oe"), F.col("text").alias("_match"), F.timestamp_millis("begin_ms").alias("_o")).where("_ob is not null and _oe is not null").withWatermark("_o", delay)
    inside = "_ob >= begin_ms and _ob <= end_ms"
    near = f"_o >= _a - interval {longest} and _o <= _a + interval {longest}"
    met = a.join(o, F.expr(f"_t = _ot and {near} and (({inside}) or (_oe >= begin_ms and _ob <= end_ms))"), "left_outer")
    best = F.when(F.col("_ob").isNotNull(), F.struct(F.expr(f"not ({inside})").alias("outside"), "_ob", "_op", "_match"))
    found = met.groupBy("_t", "_p", "begin_ms", "end_ms", "text", "_a").agg(F.min(best).alias("m"))
    return found.select(F.col("_t").alias(track), F.col("_p").alias(order), "begin_ms", "end_ms", "text", F.coalesce("m._match", F.lit(default)).alias("match"))


def stream_word_counts(sdf: DataFrame, pairs: str = "pairs_raw") -> DataFrame:
    """Running counts (word, n), for update or complete mode; the state is the vocabulary."""
    return sdf.select(F.explode(pair_words(pairs)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def stream_chunks(sdf: DataFrame, ms: int = 30_000, delay: str = "1 minute", track: str = "track_id", ts: str = "ts") -> DataFrame:
    """Rows (track, chunk_start, cues): cues of each tumbling chunk, closed by the watermark."""
    e = _event_time(sdf, ts).withWatermark(ts, delay)
    return e.groupBy(track, F.window(ts, f"{ms} milliseconds").alias("w")).agg(F.count("*").alias("cues")).select(track, F.col("w.start").alias("chunk_start"), "cues")


def stream_dedupe(sdf: DataFrame, id_col: str = "id", delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The first row of each id within the watermark's delay."""
    return _event_time(sdf, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])
