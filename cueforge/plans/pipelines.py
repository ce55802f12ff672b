"""The library's jobs, composed from its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueforge.functions.pairs import format_pairs, parse_pairs, parse_pairs_strict
from cueforge.functions.text import clean_zht
from cueforge.functions.timecode import ms_to_secs
from cueforge.operators.align import align_tracks, merge_same_begin
from cueforge.operators.catalog import cjk_lines
from cueforge.operators.retime import adjust_end_times, chunk_fixed, rebase_chunk_times
from cueforge.operators.sanitize import drop_bad_rows, filter_known_words, new_lexicon_entries
from cueforge.operators.translate import distinct_enrichment, replace_phrases, translate_by_dictionary
from cueforge.operators.vocab import word_counts, word_totals
from cueforge.sources.writers import render_srt


def build_base(zht: DataFrame, other: DataFrame, fn: Callable[[str], str] | None = None, track: str = "track_id", order: str = "pos") -> DataFrame:
    """Base rows (track, line_no, idx, begin_ms, end_ms, zht, pairs_raw, pt) of two cue tracks: merge, align, gloss, number."""
    aligned = align_tracks(merge_same_begin(zht, track, order), merge_same_begin(other, track, order), track, order)
    glossed = distinct_enrichment(aligned, "text", fn, "pairs_raw") if fn else aligned.withColumn("pairs_raw", F.lit("N/A"))
    n = F.row_number().over(Window.partitionBy(track).orderBy("begin_ms", order))
    return glossed.select(track, n.alias("line_no"), n.alias("idx"), "begin_ms", "end_ms", F.col("text").alias("zht"), F.coalesce("pairs_raw", F.lit("N/A")).alias("pairs_raw"), F.col("match").alias("pt"))


def prepare_episode_base(lines: DataFrame, lexicon: DataFrame, durations: DataFrame, chunk_ms: int = 30_000, track: str = "track_id", empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunk rows, new lexicon entries) of base rows: re-time, clean, filter known words, cut in chunks, rebase. ``empty``: also chunks without rows."""
    timed = drop_bad_rows(adjust_end_times(lines, track)).withColumn("zht", clean_zht("zht")).withColumn("pairs", parse_pairs_strict("pairs_raw"))
    entries = new_lexicon_entries(timed, lexicon, [track, "line_no"])
    kept = filter_known_words(timed, lexicon, [track, "line_no"]).withColumn("pairs_raw", F.when(F.size("pairs") > 0, format_pairs("pairs")).otherwise(F.col("pairs_raw")))
    return rebase_chunk_times(chunk_fixed(kept, durations, chunk_ms, track, "line_no", empty)), entries


def vocabulary_report(base: DataFrame, pairs: str = "pairs_raw") -> tuple[DataFrame, DataFrame]:
    """(word counts in order, totals)."""
    counts = word_counts(base, pairs)
    return counts, word_totals(counts)


def text_study_base(lines: DataFrame, gloss: Callable[[str], str], translate: Callable[[str], str], lexicon: DataFrame, script_class: str = r"[一-鿿]", keys: tuple[str, ...] = ("track_id", "line_no")) -> DataFrame:
    """Study rows (keys, value, pairs_raw, translation) of text lines in the script, without known words."""
    rows = cjk_lines(lines, "value", script_class).select(*keys, "value")
    both = distinct_enrichment(distinct_enrichment(rows, "value", gloss, "pairs_raw"), "value", translate, "translation")
    kept = filter_known_words(both.withColumn("pairs", parse_pairs("pairs_raw")), lexicon, list(keys))
    return kept.withColumn("pairs_raw", F.when(F.size("pairs") > 0, format_pairs("pairs")).otherwise(F.col("pairs_raw"))).drop("pairs")


def vtt_to_srt(cues: DataFrame) -> DataFrame:
    """SRT texts of cues read from VTT."""
    return render_srt(cues)


def to_traditional(df: DataFrame, phrases: DataFrame | list[tuple[str, str]], dictionary: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``df`` with ``traditional`` and, given a phrase table, its ``translation``."""
    out = replace_phrases(df, phrases, text, "traditional")
    return out if dictionary is None else translate_by_dictionary(out, dictionary, "traditional")


def translate_track(cues: DataFrame, existing: DataFrame, fn: Callable[[str], str], track: str = "track_id", order: str = "pos") -> DataFrame:
    """Translated cues (track, begin_ms, end_ms, text), one a begin, of groups with text that ``existing`` lacks."""
    groups = merge_same_begin(cues, track, order).where("text <> ''").groupBy(track, "begin_ms").agg(F.max("end_ms").alias("end_ms"), F.min_by("text", order).alias("text"))
    new = groups.join(existing.select(track, "begin_ms").distinct(), [track, "begin_ms"], "left_anti")
    return distinct_enrichment(new, "text", fn, "translated").select(track, "begin_ms", "end_ms", F.col("translated").alias("text"))


def printed_base(base: DataFrame, track: str = "track_id") -> DataFrame:
    """Base rows with their times as written."""
    return base.withColumns({"begin": ms_to_secs("begin_ms"), "end": ms_to_secs("end_ms")})
