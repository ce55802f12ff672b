"""Cleaning base rows and filtering glosses against a lexicon.

Lists are exploded with the outer form: for the inner one the optimizer infers a filter on the list, which
would compute a derived list twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueforge.functions.pairs import find_pairs_column, format_pairs, parse_pairs_strict
from cueforge.functions.text import trim_all
from cueforge.functions.timecode import _col

#: Answers of a model that had nothing to translate.
REFUSALS = (
    "Infelizmente, não há uma frase em chinês fornecida para eu extrair e traduzir. Por favor, envie a frase em chinês tradicional para que eu possa ajudá-lo.",
    "A frase fornecida é muito curta e não contém palavras chinesas para extrair. Por favor, forneça uma frase em chinês tradicional para que eu possa realizar a extração conforme solicitado.",
    "A frase fornecida está vazia, portanto, não há palavras para extrair e traduzir.",
)
#: Fixed value: the bits of a long, each a place.
PLACES = 64


def drop_bad_rows(df: DataFrame, refusals: tuple[str, ...] = REFUSALS, music_col: str = "zht", pairs: str = "pairs_raw") -> DataFrame:
    """Rows whose glosses are no refusal and whose ``music_col`` is not just a note.

    ``music_col='legacy'`` tests the third column of a split line (``parts``), whatever it holds.
    """
    music = F.get("parts", F.lit(2)) if music_col == "legacy" else _col(music_col)
    return df.where(~F.coalesce(trim_all(pairs).isin(*refusals), F.lit(False))).where(~F.coalesce(trim_all(music) == "♪", F.lit(False)))


def speakable_rows(df: DataFrame, pt: str = "pt") -> DataFrame:
    """Rows with a translation to speak."""
    return df.where(F.coalesce(trim_all(pt), F.lit("")) != "").where(trim_all(pt) != "N/A")


def filter_known_words(df: DataFrame, lexicon: DataFrame, keys: list[str], pairs: str = "pairs", known_level: int = 3, small_lexicon: bool = False) -> DataFrame:
    """``df`` with the glosses whose word is not known; rows whose glosses all go are dropped.

    A word is known at confidence ``known_level``; a confidence that is no whole number is 0. Rows
    without glosses stay. Only words and their places meet the known ones, by a join on the word;
    ``small_lexicon`` asserts that they fit a broadcast. ``keys`` identify a row: the rows themselves are
    shuffled once at most, to meet the places that go.
    """
    met = _with_known_places(df, F.transform(pairs, lambda p: p["word"]), lexicon, keys, known_level, small_lexicon)
    n = F.coalesce(F.size(pairs), F.lit(0))
    kept = _kept(F.col(pairs)).alias("_kept")
    out = met.select("*", kept).where((F.size("_kept") > 0) | (n <= 0) | F.coalesce(F.exists(pairs, lambda p: p.isNull()), F.lit(False)))
    told = F.when(F.size("_kept") > 0, F.col("_kept")).when(n <= 0, F.col(pairs))
    return out.select(*[told.alias(c) if c == pairs else F.col(c) for c in df.columns])


def _with_known_places(df: DataFrame, words: Column, lexicon: DataFrame, keys: list[str], known_level: int, small_lexicon: bool) -> DataFrame:
    """``df`` with ``_gone``: the places, from 0, of the ``words`` of a row that the lexicon knows; null without any."""
    known = lexicon.where(F.coalesce(F.col("confidence_level").cast("string").try_cast("int"), F.lit(0)) == known_level).select("word").distinct()
    # Hash joins on the narrow sides: neither the places of a frequent word nor the rows with their glosses are sorted.
    known = F.broadcast(known) if small_lexicon else known.hint("shuffle_hash")
    named = {c: f"_key{i}" for i, c in enumerate(keys)}
    each = df.select(*[F.col(c).alias(k) for c, k in named.items()], F.posexplode_outer(words).alias("_no", "word"))
    # The places go to their row as they are met, and become bits there: a frequent word's places are neither sorted nor held.
    met = each.join(known, "word", "left_semi").select(*named.values(), "_no").repartition(*named.values())
    bits = met.groupBy(*named.values(), F.expr(f"_no div {PLACES}").cast("int").alias("_part")).agg(F.bit_or(F.expr(f"shiftleft(1L, _no % {PLACES})")).alias("_bits"))
    listed = F.flatten(F.transform(F.collect_list(F.struct("_part", "_bits")), _places))
    gone = bits.groupBy(*named.values()).agg(listed.alias("_gone"))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in named.items()]
    return df.join(gone.hint("shuffle_hash"), same, "left").drop(*named.values())


def _places(x: Column) -> Column:
    """The places that the bits of a part stand for."""
    first = x["_part"] * PLACES
    return F.filter(F.sequence(first, first + (PLACES - 1)), lambda i: F.getbit(x["_bits"], i % PLACES) == 1)


def _kept(pairs: Column) -> Column:
    """The glosses whose places aren't in ``_gone`` and that have a word, in order."""
    places = F.when(F.size(pairs) > 0, F.sequence(F.lit(0), F.size(pairs) - 1)).otherwise(F.array().cast("array<int>"))
    left = F.array_except(places, F.coalesce("_gone", F.array().cast("array<int>")))
    return F.filter(F.transform(left, lambda i: F.get(pairs, i)), lambda p: trim_all(p["word"]) != "")


def filter_known_in_lines(lines: DataFrame, lexicon: DataFrame, track: str = "track_id", line_no: str = "line_no", value: str = "value", small_lexicon: bool = False) -> DataFrame:
    """``lines`` of tab-separated study files with the known words gone from their glosses, wherever these stand.

    The gloss column is found by itself, once for a track, by its first line that has one (``find_pairs_column``); lines before that one, lines without
    that column, and glosses that are no list stay as they are. A line whose glosses all go is dropped. Rules of
    ``filter_known_words``; ``line_no`` tells the lines of a track apart.
    """
    at = find_pairs_column(lines, track, line_no, value).select(F.col("track_id").alias("_t"), F.col("col").alias("_col"), F.col("line_no").alias("_from"))
    found = lines.join(at, F.col(track).eqNullSafe(F.col("_t")), "left").drop("_t")
    parts = F.split(value, "\t")
    pairs = parse_pairs_strict(F.when(F.col(line_no) >= F.col("_from"), F.get(parts, F.col("_col"))))
    # Parsed where their words are looked up and again where they are written, a line's glosses don't travel.
    met = _with_known_places(found, F.transform(pairs, lambda p: p["word"]), lexicon, [track, line_no], 3, small_lexicon)
    told = lambda k: F.array_join(F.transform(parts, lambda x, i: F.when(i == F.col("_col"), format_pairs(k)).otherwise(x)), "\t")
    written = lambda k, p: F.when(F.size(k) > 0, F.array(F.struct(told(k).alias("v")))).when(F.size(p) == 0, F.array(F.struct(F.col(value).alias("v"))))
    # Lists of one: what is in them is computed once.
    one = F.get(F.transform(F.array(pairs), lambda p: F.get(F.transform(F.array(_kept(p)), lambda k: written(k, p)), F.lit(0))), F.lit(0))
    kept = met.select(*[c for c in lines.columns if c != value], F.explode_outer(one).alias("_line")).where("_line is not null")
    return kept.select(*[F.col("_line.v").alias(c) if c == value else F.col(c) for c in lines.columns])


def new_lexicon_entries(df: DataFrame, lexicon: DataFrame, order: list[str], pairs: str = "pairs") -> DataFrame:
    """Lexicon rows of words that it lacks, from their first occurrence by ``order``, confidence 1."""
    each = df.select(*order, F.posexplode_outer(pairs).alias("_no", "_pair")).where(trim_all("_pair.word") != "")
    new = each.select(F.col("_pair.word").alias("word"), F.struct(*order, "_no").alias("_at"), F.struct("_pair.pinyin", "_pair.translation").alias("_v"))
    first = new.groupBy("word").agg(F.min(F.struct("_at", "_v")).alias("f"))
    return first.join(lexicon.select("word").distinct(), "word", "left_anti").select("word", F.col("f._v.pinyin").alias("pinyin"), F.col("f._v.translation").alias("translation"), F.lit(1).alias("confidence_level"))


def upsert_lexicon(lexicon: DataFrame, entries: DataFrame) -> DataFrame:
    """The lexicon with its new entries."""
    return lexicon.select("word", "pinyin", "translation", F.col("confidence_level").cast("string").alias("confidence_level")).unionByName(entries.withColumn("confidence_level", F.col("confidence_level").cast("string")))


def sanitize_summary(before: DataFrame, after: DataFrame, keys: list[str], text: str = "zht", pairs: str = "pairs") -> DataFrame:
    """One row: rows removed and modified, glosses kept and dropped. Texts meet as their SHA-256."""
    digest = F.unhex(F.sha2(F.col(text).cast("string").cast("binary"), 256))
    b = before.select(*keys, digest.alias("_t0"), F.size(pairs).alias("_n0"))
    a = after.select(*keys, digest.alias("_t1"), F.size(pairs).alias("_n1"), F.lit(1).alias("_in"))
    j = b.join(a, keys, "left")
    n0, n1 = F.greatest("_n0", F.lit(0)), F.coalesce(F.greatest("_n1", F.lit(0)), F.lit(0))
    return j.agg(
        F.count_if(F.col("_in").isNull()).alias("removed"),
        F.count_if(F.col("_in").isNotNull() & (~F.col("_t0").eqNullSafe(F.col("_t1")) | (n0 != n1))).alias("modified"),
        F.coalesce(F.sum(n1), F.lit(0)).cast("long").alias("pairs_kept"),
        F.coalesce(F.sum(n0 - n1), F.lit(0)).cast("long").alias("pairs_dropped"),
    )
