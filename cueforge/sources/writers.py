"""Cue tables and episodes as files: each ``render_*`` gives one text a track, each ``write_*`` stores them.

``packed`` stores many tracks' texts in each of few Parquet files, which the readers take with ``packed`` too: a folder and a file for each of
hundreds of thousands of small tracks cost more time to make, list and open than all work on their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueforge.functions.text import squeeze
from cueforge.functions.timecode import ms_to_secs, ms_to_srt

EPISODE_COLUMNS = ("id", "episode_number", "chapter_date", "title", "url", "type")


def _joined(df: DataFrame, track: str, order: str, block: Column, sep: str) -> DataFrame:
    """One text a track of its blocks in order; a track is hours of cues at most."""
    e = df.select(F.col(track).alias("track_id"), F.struct(F.col(order).alias("o"), block.alias("b")).alias("x"))
    return e.groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), sep).alias("content"))


def render_srt(df: DataFrame, track: str = "track_id", order: str = "pos") -> DataFrame:
    """Rows (track_id, content): SRT, renumbered from 1."""
    n = F.row_number().over(Window.partitionBy(track).orderBy(order))
    block = F.concat(F.col("_n").cast("string"), F.lit("\n"), ms_to_srt("begin_ms"), F.lit(" --> "), ms_to_srt("end_ms"), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _joined(df.withColumn("_n", n), track, order, block, "\n")


def _field(c: str) -> Column:
    return squeeze(F.coalesce(F.col(c).cast("string"), F.lit("")))


def base_line(df: DataFrame) -> Column:
    """The six-column line of a base row, safe against tabs and line ends; nulls are empty columns."""
    known = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws("\t", known(F.col("idx").cast("string")), known(ms_to_secs("begin_ms")), known(ms_to_secs("end_ms")), _field("zht"), _field("pairs_raw"), _field("pt"))


def render_base(df: DataFrame, track: str = "track_id", order: str = "line_no") -> DataFrame:
    """Rows (track_id, content): tab-separated base lines."""
    return _joined(df, track, order, base_line(df), "\n")


def render_chunk_base(df: DataFrame, track: str = "track_id", chunk: str = "chunk_no") -> DataFrame:
    """Rows (track_id, chunk_no, content): the base lines of each chunk in order of begin, numbered from 1.

    ``df`` has the rows of ``rebase_chunk_times``; chunks without lines have no file.
    """
    w = Window.partitionBy(track, chunk).orderBy("begin_ms", "line_no")
    lines = df.where("begin_ms is not null").withColumn("idx", F.row_number().over(w))
    e = lines.select(F.col(track).alias("track_id"), F.col(chunk).alias("chunk_no"), F.struct("idx", base_line(lines).alias("b")).alias("x"))
    return e.groupBy("track_id", "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n").alias("content"))


def render_text_base(df: DataFrame, track: str = "track_id", order: str = "line_no") -> DataFrame:
    """Rows (track_id, content): study lines without times (text, glosses, translation)."""
    return _joined(df, track, order, F.concat_ws("\t", _field("value"), _field("pairs_raw"), _field("translation")), "\n")


def escaped(c: str) -> Column:
    """Text of XML."""
    out = F.col(c)
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt")):
        out = F.replace(out, F.lit(char), F.lit(f"&{name};"))
    return out


def render_ttml_secs(df: DataFrame, track: str = "track_id", order: str = "pos") -> DataFrame:
    """Rows (track_id, content): TTML with times in seconds."""
    line = F.concat(F.lit('<p begin="'), ms_to_secs("begin_ms"), F.lit('" end="'), ms_to_secs("end_ms"), F.lit('">'), escaped("text"), F.lit("</p>"))
    body = _joined(df, track, order, line, "\n")
    return body.withColumn("content", F.concat(F.lit('<tt xmlns="http://www.w3.org/ns/ttml"><body><div>\n'), "content", F.lit("\n</div></body></tt>")))


#: Bytes of a row group of packed texts: what a task holds at once when it reads them.
_GROUP = 16 << 20


def _store(rendered: DataFrame, path: str, packed: bool = False) -> None:
    if packed:
        rendered.select("track_id", F.col("content").alias("value")).write.mode("overwrite").option("parquet.block.size", _GROUP).parquet(path)
        return
    rendered.select("track_id", F.col("content").alias("value")).write.mode("overwrite").partitionBy("track_id").option("lineSep", "\n").text(path)


def write_srt(df: DataFrame, path: str, packed: bool = False) -> None:
    """SRT files, a folder for each track, or packed."""
    _store(render_srt(df), path, packed)


def write_base(df: DataFrame, path: str, packed: bool = False) -> None:
    """Base files, a folder for each track, or packed."""
    _store(render_base(df), path, packed)


def write_chunk_base(df: DataFrame, path: str) -> None:
    """Base files, a folder for each track and chunk."""
    render_chunk_base(df).select("track_id", "chunk_no", F.col("content").alias("value")).write.mode("overwrite").partitionBy("track_id", "chunk_no").option("lineSep", "\n").text(path)


def write_text_base(df: DataFrame, path: str, packed: bool = False) -> None:
    """Study files without times, a folder for each track, or packed."""
    _store(render_text_base(df), path, packed)


def write_ttml_secs(df: DataFrame, path: str, packed: bool = False) -> None:
    """TTML files, a folder for each track, or packed."""
    _store(render_ttml_secs(df), path, packed)


def episodes_envelope(df: DataFrame, source_url: str, extraction_date: str, order: str = "pos", source: str | None = None) -> DataFrame:
    """One row (value) of all, or a row (source, value) a source, with the JSON envelope of its episodes.

    A source's address is ``source_url`` and its name. Each envelope is made where its source's episodes meet.
    """
    e = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*EPISODE_COLUMNS).alias("e")))), lambda x: x["e"])
    address = F.lit(source_url) if source is None else F.concat(F.lit(source_url + "/"), F.coalesce(F.col(source).cast("string"), F.lit("")))
    meta = F.struct(address.alias("source_url"), F.lit(extraction_date).alias("extraction_date"), F.count("*").cast("int").alias("total_episodes"))
    value = F.to_json(F.struct(meta.alias("metadata"), e.alias("episodes"))).alias("value")
    return df.agg(value) if source is None else df.groupBy(source).agg(value)


def write_episodes_json(df: DataFrame, path: str, source_url: str, extraction_date: str, order: str = "pos", source: str | None = None) -> None:
    """The envelope as a file; with ``source`` a folder for each source."""
    told = episodes_envelope(df, source_url, extraction_date, order, source).write.mode("overwrite")
    (told if source is None else told.partitionBy(source)).text(path)


def write_episodes_csv(df: DataFrame, path: str) -> None:
    """Episodes as CSV with a header, columns in fixed order."""
    df.select(*EPISODE_COLUMNS).write.mode("overwrite").csv(path, header=True)
