"""Subtitle, study-table and episode files as DataFrames. One row a cue or line; track_id is the file's stem.

``packed``: the path has texts of many tracks in each file, as the writers store them with ``packed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueforge.functions.text import squeeze, trim_all
from cueforge.functions.timecode import secs_to_ms, srt_to_ms, ticks_to_secs, vtt_to_ms
from cueforge.operators.scan import SPAN, ranked

BOM = "﻿"


def _track(path: Column) -> Column:
    """Value of the folder that partitions the files, else the file name without its last extension."""
    folder = F.url_decode(F.regexp_extract(path, r"/[A-Za-z_]+=([^/]+)/[^/]+$", 1))
    return F.when(folder != "", folder).otherwise(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))


def _texts(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Rows (track_id, text) of whole files, without a byte order mark, line ends as ``\\n``."""
    raw = spark.read.schema("track_id string, value string").parquet(path) if packed else spark.read.text(path, wholetext=True)
    body = F.regexp_replace(F.replace("value", F.lit(BOM), F.lit("")), "\r\n?", "\n")
    return raw.select("track_id" if packed else _track(F.col("_metadata.file_path")).alias("track_id"), body.alias("text"))


def _ranked(df: DataFrame, order: list[str], span: int, packed: bool) -> DataFrame:
    """``df`` with ``idx``, the place in its track. A packed track comes out of one row, so one window holds it and the texts are parsed once."""
    if packed:
        return df.withColumn("idx", F.row_number().over(Window.partitionBy("track_id").orderBy(*order)))
    return ranked(df, "track_id", order, "idx", span)


def _blocks(texts: DataFrame, text: Column) -> DataFrame:
    """Rows (track_id, pos, lines) of the blocks between empty lines."""
    cut = texts.select("track_id", F.posexplode_outer(F.split(trim_all(text), r"\n[ \t]*\n\s*")).alias("pos", "_b")).where("_b is not null")
    return cut.select("track_id", "pos", F.split("_b", "\n").alias("lines"))


def _pieces(spark: SparkSession, path: str, sep: str, streamed: bool = False) -> DataFrame:
    """Rows (track_id, at, text) of the pieces of files between ``sep``: Spark cuts a large file in byte ranges there, so many tasks read it.

    ``at`` rises in file order. A piece may hold several blocks (other line ends, blanks in the empty line); the next step parts them.
    """
    raw = (spark.readStream if streamed else spark.read).option("lineSep", sep).text(path)
    body = F.regexp_replace(F.replace("value", F.lit(BOM), F.lit("")), "\r\n?", "\n")
    track = _track(F.col("_metadata.file_path")).alias("track_id")
    if streamed:
        return raw.select(track, body.alias("text"))
    # The start of the byte range, and the row in its task: fewer rows than bytes, so the next range comes after it.
    at = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return raw.select(track, at.alias("at"), body.alias("text"))


#: Blocks of one piece that keep their order in ``pos``.
_IN_PIECE = 1 << 24


def _split_blocks(pieces: DataFrame) -> DataFrame:
    """Rows (track_id, pos, lines) of the blocks of pieces; ``pos`` rises in file order but isn't consecutive."""
    each = pieces.where(trim_all("text") != "").select("track_id", "at", F.posexplode(F.split(trim_all("text"), r"\n[ \t]*\n\s*")).alias("_k", "_b"))
    return each.select("track_id", (F.col("at") * _IN_PIECE + F.col("_k")).alias("pos"), F.split("_b", "\n").alias("lines"))


def read_srt(spark: SparkSession, path: str, strict: bool = True, split: bool = False, line_end: str = "\n", packed: bool = False) -> DataFrame:
    """Cues of SRT files: (track_id, pos, idx, begin_ms, end_ms, text).

    Strict: blocks need a whole-number index, a time line and text; text keeps its line ends. Lenient: the
    index is not looked at, lines join with a space, empty texts drop. Malformed blocks are skipped.

    ``split``: large files are cut at empty lines (of ``line_end``, which only decides where a file can be cut) and read by many tasks; ``pos`` then rises in file order with gaps.
    """
    b = _split_blocks(_pieces(spark, path, line_end * 2)) if split else _blocks(_texts(spark, path, packed), F.col("text"))
    return _srt_cues(b, strict)


def _srt_cues(b: DataFrame, strict: bool) -> DataFrame:
    keys = [c for c in b.columns if c != "lines"]
    b = b.where("size(lines) >= 3")
    times = F.split(F.col("lines")[1], " --> ")
    b = b.where(F.size(times) == 2)
    sep = "\n" if strict else " "
    body = trim_all(F.array_join(F.slice("lines", 3, F.size("lines")), sep))
    out = b.select(*keys, trim_all(F.col("lines")[0]).try_cast("int").alias("idx"), srt_to_ms(times[0], not strict).alias("begin_ms"), srt_to_ms(times[1], not strict).alias("end_ms"), body.alias("text"))
    return out.where("idx is not null and begin_ms is not null and end_ms is not null") if strict else out.where("text <> ''")


def stream_srt(spark: SparkSession, path: str, strict: bool = True, line_end: str = "\n") -> DataFrame:
    """Cues (track_id, idx, begin_ms, end_ms, text) of SRT files as they arrive in a folder; rules of ``read_srt``, with files cut as there.

    A stream has no place in a file: ``idx`` and the times tell the order.
    """
    pieces = _pieces(spark, path, line_end * 2, streamed=True).where(trim_all("text") != "")
    blocks = pieces.select("track_id", F.explode(F.split(trim_all("text"), r"\n[ \t]*\n\s*")).alias("_b")).select("track_id", F.split("_b", "\n").alias("lines"))
    return _srt_cues(blocks, strict)


def read_vtt(spark: SparkSession, path: str, truncate: bool = False, hours: bool = True, split: bool = False, line_end: str = "\n", packed: bool = False) -> DataFrame:
    """Cues of VTT files; blocks must begin with their time line; lines join with a space; empty texts drop.

    ``split``: as in ``read_srt``; ``idx`` is then the order among all cues of a track all the same.
    """
    if split:
        b = _split_blocks(_pieces(spark, path, line_end * 2))
    else:
        texts = _texts(spark, path, packed)
        b = _blocks(texts, F.regexp_replace("text", r"^WEBVTT[^\n]*\n\n", ""))
    b = b.where(F.instr(F.col("lines")[0], "-->") > 0)
    times = F.split(F.col("lines")[0], r"\s*-->\s*")
    body = trim_all(F.array_join(F.slice("lines", 2, F.size("lines")), " "))
    out = b.where(F.size(times) == 2).select("track_id", "pos", vtt_to_ms(times[0], truncate, hours).alias("begin_ms"), vtt_to_ms(times[1], truncate, hours).alias("end_ms"), body.alias("text"))
    return _ranked(out.where("text <> ''"), ["pos"], SPAN * _IN_PIECE if split else SPAN, packed).select("track_id", "pos", "idx", "begin_ms", "end_ms", "text")


#: The end of an element of XML, and character references to Unicode's characters.
_PARAGRAPH = r"(?s)<(?:\w+:)?p(?:\s[^>]*)?(?:/>|>.*?</(?:\w+:)?p\s*>)"
_REFERENCE = r"&(?:#(\d{1,7})|#[xX]([0-9A-Fa-f]{1,6})|(lt|gt|quot|apos|amp));"


def xml_text(c: Column | str) -> Column:
    """Character data of an XML fragment: comments and processing instructions go, CDATA stays as it is, tags go, references become characters.

    A reference to no character, and any other name, stay as they are.
    """
    # CDATA apart: odd pieces are what stands in it.
    bare = F.regexp_replace(c, r"(?s)<!--.*?-->|<\?.*?\?>", "")
    pieces = F.split(F.regexp_replace(bare, r"(?s)<!\[CDATA\[(.*?)\]\]>", "\u0001$1\u0001"), "\u0001")

    def told(piece: Column) -> Column:
        # Each part after the first begins with a reference.
        parts = F.split(F.regexp_replace(piece, r"<[^>]*>", ""), rf"(?={_REFERENCE})")
        code = lambda x: F.coalesce(F.regexp_extract(x, f"^{_REFERENCE}", 1).try_cast("int"), F.conv(F.nullif(F.regexp_extract(x, f"^{_REFERENCE}", 2), F.lit("")), 16, 10).try_cast("int"))
        known = F.create_map(*[F.lit(x) for pair in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")) for x in pair])
        valid = lambda n: (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        char = lambda x: F.when(valid(code(x)), _character(code(x))).otherwise(known[F.regexp_extract(x, f"^{_REFERENCE}", 3)])
        each = F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^{_REFERENCE}"), F.coalesce(F.concat(char(x), F.regexp_replace(x, f"^{_REFERENCE}", "")), x)).otherwise(x)), "")
        # Without numbers the five names are enough, the ampersand last: what it makes is no reference.
        named = F.regexp_replace(piece, r"<[^>]*>", "")
        for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
            named = F.replace(named, F.lit(f"&{name};"), F.lit(c))
        return F.when(piece.contains("#"), each).otherwise(named)

    return F.when(bare.contains("<![CDATA["), F.array_join(F.transform(pieces, lambda x, k: F.when(k % 2 == 1, x).otherwise(told(x))), "")).otherwise(told(bare))


def _character(n: Column) -> Column:
    """The character of a code point, by its four bytes of UTF-32."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")


def read_ttml(spark: SparkSession, path: str, split: bool = False, paragraph_end: str = "</p>", packed: bool = False) -> DataFrame:
    """Cues of TTML files in order of begin: every ``<p>`` of any prefix, nested text joined, white space collapsed.

    A missing begin is 0, a missing end the begin; ticks use the document's tick rate; other times are skipped. References and CDATA are
    characters, comments are nothing. ``split``: large files are cut after ``paragraph_end`` and read by many tasks.
    """
    if split:
        pieces = _pieces(spark, path, paragraph_end)
        t = pieces.select("track_id", "at", F.concat("text", F.lit(paragraph_end)).alias("text"))
    else:
        t = _texts(spark, path, packed).withColumn("at", F.lit(0).cast("long"))
    hidden = F.regexp_replace("text", r"(?s)<!--.*?-->", "")
    told = F.regexp_extract("text", r"tickRate\s*=\s*[\x22'](\d{1,12})[\x22']", 1).try_cast("long")
    found = t.select("track_id", "at", told.alias("_own"), F.regexp_extract_all(hidden, F.lit(_PARAGRAPH), F.lit(0)).alias("_all"))
    e = found.select("track_id", "at", "_own", F.posexplode_outer("_all").alias("_k", "_p")).where("_p is not null")
    if split:
        # The rate stands before the first paragraph of a file: few pieces have one.
        rates = t.where(told.isNotNull()).groupBy("track_id").agg(F.min_by(told, "at").alias("_rate"))
        e = e.join(rates, "track_id", "left")
    else:
        e = e.withColumn("_rate", F.col("_own"))
    opening = F.regexp_extract("_p", r"^(<[^>]*>)", 1)

    def attr(name: str) -> Column:
        return F.regexp_extract(opening, rf"\s{name}\s*=\s*[\x22']([^\x22']*)[\x22']", 1).alias(name)

    def time(name: str, default: Column) -> Column:
        raw = F.col(f"_raw.{name}")
        told = F.when(raw.endswith("t"), secs_to_ms(ticks_to_secs(raw, F.col("_rate")), True)).otherwise(secs_to_ms(raw, True))
        return F.when(raw == "", default).otherwise(told)

    body = xml_text(F.regexp_replace("_p", r"^<[^>]*>|</(?:\w+:)?p\s*>$", ""))
    # Lists of one: what is in them is computed once, not again for the filter.
    e = e.withColumn("_raw", F.explode_outer(F.array(F.struct(attr("begin"), attr("end")))))
    e = e.withColumn("_ms", F.explode_outer(F.array(F.struct(time("begin", F.lit(0).cast("long")).alias("begin"), time("end", F.lit(None).cast("long")).alias("end")))))
    e = e.withColumns({"begin_ms": F.col("_ms.begin"), "end_ms": F.when(F.col("_raw.end") == "", F.col("_ms.begin")).otherwise(F.col("_ms.end"))}).where("begin_ms is not null and end_ms is not null")
    n = _ranked(e, ["begin_ms", "at", "_k"], 1 << 22, packed)
    return n.select("track_id", (F.col("idx") - 1).alias("pos"), "idx", "begin_ms", "end_ms", squeeze(body).alias("text"))


def parse_base_lines(lines: DataFrame, min_columns: int = 4, dedupe: str | None = "last") -> DataFrame:
    """Base rows of ``lines(track_id, line_no, value)``.

    Six columns or more are the new layout, four or five the old one; without an end, or with one that
    isn't a time, a row lasts 3 s. ``N/A`` becomes empty, one outer ``（…）`` goes; rows without Chinese text or a begin
    drop; the shortest duration is 0.5 s. Of rows with the same begin the last line stays (``dedupe`` 'first', or
    None for all). Empty columns at the end of a line count: lines aren't stripped before they are split.
    """
    p = F.split("value", "\t")
    n = F.size(p)
    new = n >= 6
    layout = F.when(new, "new").when(n >= 4, "old").otherwise("bad")
    at = lambda k: F.get(p, F.lit(k))
    zht = trim_all(F.when(new, at(3)).otherwise(at(2)))
    zht = F.regexp_replace(zht, r"(?s)^（(.*)）$", "$1")
    blank = lambda c: F.when(trim_all(c) == "N/A", "").otherwise(F.coalesce(trim_all(c), F.lit("")))
    begin = secs_to_ms(at(1))
    end = F.coalesce(F.when(new, secs_to_ms(at(2))), begin + 3000)
    out = lines.where(n >= min_columns).select("track_id", "line_no", trim_all(at(0)).try_cast("int").alias("idx"), begin.alias("begin_ms"), F.greatest(end, begin + 500).alias("end_ms"), zht.alias("zht"), blank(F.when(new, at(4)).otherwise(at(3))).alias("pairs_raw"), blank(F.when(new, at(5)).otherwise(at(4))).alias("pt"), layout.alias("layout"))
    out = out.where("begin_ms is not null and end_ms is not null and zht <> '' and zht <> 'N/A'")
    if dedupe is None:
        return out
    pick = F.max_by if dedupe == "last" else F.min_by
    rest = [c for c in out.columns if c not in ("track_id", "begin_ms")]
    return out.groupBy("track_id", "begin_ms").agg(pick(F.struct(*rest), "line_no").alias("r")).select("track_id", "begin_ms", "r.*").select(*out.columns)


def read_lines(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Rows (track_id, line_no, value) of physical lines, numbered from 1 within each file."""
    # The line end of the last line goes before the text is cut: with a look at the text for each line, the text would travel with each.
    whole = F.when(F.col("text").endswith("\n"), F.substring("text", F.lit(1), F.length("text") - 1)).when(F.col("text") != "", F.col("text"))
    e = _texts(spark, path, packed).select("track_id", F.posexplode_outer(F.split(whole, "\n")).alias("_k", "value"))
    return e.where("value is not null").select("track_id", (F.col("_k") + 1).alias("line_no"), "value")


def read_base(spark: SparkSession, path: str, min_columns: int = 4, dedupe: str | None = "last", packed: bool = False) -> DataFrame:
    """Base rows of tab-separated files (see ``parse_base_lines``)."""
    return parse_base_lines(read_lines(spark, path, packed), min_columns, dedupe)


def read_text_base(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Rows (track_id, line_no, value, pairs_raw, translation) of study tables without times; missing columns are empty."""
    p = F.split("value", "\t")
    at = lambda k: F.coalesce(trim_all(F.get(p, F.lit(k))), F.lit(""))
    return read_lines(spark, path, packed).select("track_id", "line_no", at(0).alias("value"), at(1).alias("pairs_raw"), at(2).alias("translation")).where("value <> ''")


def read_with_encoding(spark: SparkSession, path: str) -> DataFrame:
    """Rows (track_id, encoding, text): UTF-8 if valid, else Latin-1; a byte order mark goes."""
    f = spark.read.format("binaryFile").load(path)
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(utf8, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return f.select(_track(F.col("path")).alias("track_id"), F.when(utf8, "utf-8").otherwise("latin-1").alias("encoding"), F.replace(text, F.lit(BOM), F.lit("")).alias("text"))


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """The episodes of JSON envelopes; a file without any gives no row."""
    fields = "id string, episode_number string, chapter_date string, title string, url string, type string"
    raw = spark.read.schema(f"metadata struct<source_url:string,extraction_date:string,total_episodes:int>, episodes array<struct<{fields.replace(' string', ':string')}>>").json(path, multiLine=True)
    return raw.select(F.explode("episodes").alias("e")).select("e.*")
