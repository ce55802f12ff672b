"""Counting and finding words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.functions.pairs import lookup_pinyin, pair_words
from cueforge.functions.text import pinyin_slug
from cueforge.functions.timecode import secs_to_ms


def word_counts(df: DataFrame, pairs: str = "pairs_raw", top: int | None = None) -> DataFrame:
    """Rows (word, n) by n, then word, both descending."""
    counted = df.select(F.explode_outer(pair_words(pairs)).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("word"))
    return counted if top is None else counted.limit(top)


def word_totals(counts: DataFrame) -> DataFrame:
    """One row: occurrences and distinct words."""
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.count("*").alias("words"))


def find_words(base: DataFrame, words: DataFrame, track: str = "track_id", line: str = "line_no", asset: str = "asset") -> DataFrame:
    """For each line the first word of the list that heads one of its glosses, with times and picture name.

    ``base`` has parts (columns of the line), line_no and asset; ``words`` has word_index and word. A
    line whose times are no ``…s`` values is skipped.
    """
    begin, end = secs_to_ms(F.get("parts", F.lit(1)), True), secs_to_ms(F.get("parts", F.lit(2)), True)
    pairs = F.get("parts", F.lit(4))
    heads = F.transform(F.regexp_extract_all(pairs, F.lit('"([^"]+)"'), F.lit(1)), lambda x: F.regexp_extract(x, r"(?U)^\s*(\S+)", 1))
    lines = base.withColumns({"begin_ms": begin, "end_ms": end, "pairs_raw": pairs}).where("begin_ms is not null and end_ms is not null")
    # Only keys and words meet the list; a line's columns join its first word.
    each = lines.select(track, line, F.explode_outer(F.array_distinct(heads)).alias("word"))
    first = each.join(words.select("word_index", "word"), "word").groupBy(track, line).agg(F.min(F.struct("word_index", "word")).alias("_w"))
    hit = lines.join(first.select(track, line, "_w.word_index", "_w.word"), [track, line])
    pinyin = lookup_pinyin("word", "pairs_raw")
    translation = F.when(F.size("parts") > 5, F.element_at("parts", -1)).otherwise("N/A")
    number = F.col(line).cast("string")
    wide = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    name = F.concat((F.col("word_index") + 1).cast("string"), F.lit("_"), pinyin_slug(pinyin), F.lit("_line"), wide, F.lit("_"), F.col(asset), F.lit(".png"))
    mid = F.floor((F.col("begin_ms") + F.col("end_ms")) / 2).cast("long")
    return hit.select(track, line, "word_index", "word", pinyin.alias("pinyin"), "begin_ms", "end_ms", mid.alias("mid_ms"), translation.alias("translation"), name.alias("picture"))
