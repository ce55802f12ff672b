"""Gloss lists: ``["word (pinyin): translation", …]`` as text and as arrays of structs."""

from __future__ import annotations

import ast
import contextlib
import json
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueforge.functions.matching import longest_segments, occurrences
from cueforge.functions.text import trim_all
from cueforge.functions.timecode import _col

PAIR = "struct<word:string,pinyin:string,translation:string>"
#: Fixed value: the form of an item.
_ITEM = r"(?U)^([^\s(]+)\s*\(([^)]+)\)\s*:\s*(.+)$"


def _struct(word: Column, pinyin: Column, translation: Column) -> Column:
    return F.struct(word.alias("word"), pinyin.alias("pinyin"), translation.alias("translation"))


def parse_pairs(c: Column | str) -> Column:
    """Structs of a bracketed list of double-quoted items.

    An item of another shape gives what it begins with, up to white space or a parenthesis, alone; one that begins
    with either is skipped.
    """
    text = trim_all(c)
    items = F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1))
    whole = lambda x, k: F.regexp_extract(x, _ITEM, k)
    head = lambda x: _struct(F.regexp_extract(x, r"(?U)^([^\s(]+)", 1), F.lit(""), F.lit(""))
    # The item's form is matched once, which parts it at a mark; one that holds the mark itself is matched for each part.
    mark = "\u0001"
    parted = F.transform(items, lambda x: F.struct(x.alias("x"), F.split(F.regexp_replace(x, _ITEM, f"$1{mark}$2{mark}$3"), mark).alias("p")))
    marked = lambda x: F.when(x.rlike(_ITEM), _struct(trim_all(whole(x, 1)), trim_all(whole(x, 2)), trim_all(whole(x, 3)))).otherwise(head(x))
    plain = lambda y: F.when(F.size(y["p"]) == 3, _struct(trim_all(y["p"][0]), trim_all(y["p"][1]), trim_all(y["p"][2]))).otherwise(head(y["x"]))
    made = F.transform(parted, lambda y: F.when(y["x"].contains(mark), marked(y["x"])).otherwise(plain(y)))
    kept = F.filter(made, lambda x: x["word"] != "")
    return F.when(text.startswith("[") & text.endswith("]"), kept).otherwise(F.array().cast(f"array<{PAIR}>"))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _list_literal(texts: pa.Array) -> pa.Array:
    """The strings of a list literal as Python reads it; null if it is none."""

    def read(text: str | None) -> list[str] | None:
        if not text or not text.strip():
            return None
        if "\\" not in text:
            with contextlib.suppress(ValueError, RecursionError):
                plain = json.loads(text)
                if isinstance(plain, list) and all(isinstance(x, str) for x in plain):
                    return plain
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                told = ast.literal_eval(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        return [x.encode("utf-8", "replace").decode() for x in told if isinstance(x, str)] if isinstance(told, list) else None

    return pa.array(map(read, texts.to_pylist()), pa.list_(pa.string()))


def parse_pairs_strict(c: Column | str) -> Column:
    """Structs of a Python list literal: any quotes, escapes and a last comma; items need a colon, others are left out; bad lists are empty."""
    listed = _list_literal(_col(c))
    left = lambda x: trim_all(F.substring_index(x, ":", 1))
    pinyin = lambda x: F.regexp_extract(left(x), r"\(([^)]+)\)", 1)
    bare = lambda x: trim_all(F.replace(left(x), F.concat(F.lit("("), pinyin(x), F.lit(")")), F.lit("")))
    item = lambda x: _struct(F.when(pinyin(x) != "", bare(x)).otherwise(left(x)), trim_all(pinyin(x)), trim_all(F.substring(x, F.instr(x, ":") + 1, F.length(x))))
    return F.coalesce(F.transform(F.filter(listed, lambda x: F.instr(x, ":") > 0), item), F.array().cast(f"array<{PAIR}>"))


def format_pairs(c: Column | str) -> Column:
    """The text form of structs; an empty pinyin is left out."""
    item = lambda x: F.concat(F.lit('"'), x["word"], F.when(x["pinyin"] != "", F.concat(F.lit(" ("), x["pinyin"], F.lit(")"))).otherwise(F.lit("")), F.lit(": "), x["translation"], F.lit('"'))
    return F.concat(F.lit("["), F.array_join(F.transform(_col(c), item), ", "), F.lit("]"))


def pair_words(c: Column | str) -> Column:
    """Words for counting: quoted text up to white space before a parenthesis."""
    return F.transform(F.regexp_extract_all(_col(c), F.lit(r'(?U)"([^"]+?)\s+\('), F.lit(1)), lambda x: trim_all(x))


def lookup_pinyin(word: Column | str, pairs: Column | str) -> Column:
    """Pinyin of the first item whose head is ``word`` and that has one; else the word."""
    items = F.regexp_extract_all(_col(pairs), F.lit('"([^"]+)"'), F.lit(1))
    own = F.filter(items, lambda x: (F.regexp_extract(x, r"(?U)^\s*(\S+)", 1) == _col(word)) & x.rlike(r"\([^)]+\)"))
    return F.coalesce(F.regexp_extract(F.get(own, F.lit(0)), r"\(([^)]+)\)", 1), _col(word))


def segment_longest_match(text: Column | str, pairs: Column | str) -> Column:
    """Greedy split of ``text`` by the longest gloss word at each place, else one character; each with its gloss.

    An automaton of a line's words finds them in one pass. Of equal words the first counts; a null text gives null, null pairs none.
    """
    return _segments(_col(text), _col(pairs))


_SEGMENT = ("text", "pinyin", "translation")
#: Lines worked on at once: what is found in a line may be many times its length.
LINES_AT_ONCE = 64


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in _SEGMENT])))
def _segments(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, pairs in batches:
        for k in range(0, len(texts), LINES_AT_ONCE):
            yield _segmented(texts.slice(k, LINES_AT_ONCE), pairs.slice(k, LINES_AT_ONCE))


def _segmented(texts: pa.Array, pairs: pa.Array) -> pa.Array:
    """The parts of a text follow each other in its bytes: only where they begin is computed."""
    flat = pairs.flatten()
    fields = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
    words, cut = fields["word"].to_pylist(), np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(pairs), 0).to_numpy()))).tolist()
    raw, begins, told, count, base = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0], 0
    for i, text in enumerate(texts.to_pylist()):
        text = text or ""
        starts, k = longest_segments(text, words[cut[i] : cut[i + 1]])
        own = text.encode()
        if len(own) > len(text):
            starts = np.flatnonzero((np.frombuffer(own, np.uint8) & 0xC0) != 0x80)[starts]
        raw.append(own)
        begins.append(starts + base)
        told.append(np.where(k < 0, -1, k + cut[i]))
        count.append(len(starts))
        base += len(own)
    place = np.concatenate(told)
    taken = pa.array(place, mask=place < 0)
    parts = pa.Array.from_buffers(pa.string(), len(place), [None, pa.py_buffer(np.append(np.concatenate(begins), base).astype(np.int32)), pa.py_buffer(b"".join(raw))])
    # A part that is no word has empty fields; a gloss's own null stays null.
    other = pa.array(place < 0)
    given = [pc.if_else(other, "", fields[n].take(taken)) for n in ("pinyin", "translation")]
    items = pa.StructArray.from_arrays([parts, *given], _SEGMENT)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(count).astype(np.int32)), items, mask=pc.is_null(texts))


def word_places(df: DataFrame, text: str, pairs: str, out: str = "places") -> DataFrame:
    """``df`` with ``out``: structs (pair_no, word, starts) of the gloss words that occur in the line, places in code points.

    All words of a line are found in one pass by an automaton of them; occurrences of a word don't overlap each other. Glosses that are no list
    of strings are split at commas. A line in which no word occurs gives each of its characters, with pair_no -1; a null text is empty.
    """
    listed = F.from_json(F.col(pairs), "array<string>", {"allowSingleQuotes": "true"})
    loose = F.transform(F.split(F.translate(F.col(pairs), '[]"', ""), ","), lambda x: trim_all(x))
    head = lambda x: trim_all(F.when(F.instr(x, "(") > 0, F.substring_index(x, "(", 1)).otherwise(F.substring_index(x, ":", 1)))
    return df.withColumn(out, _places(F.col(text), F.transform(F.coalesce(listed, loose), head)))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("pair_no", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("starts", T.ArrayType(T.IntegerType()))])))
def _places(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Only texts and words reach Python, a few lines at a time."""
    for texts, words in batches:
        for k in range(0, len(texts), LINES_AT_ONCE):
            yield _placed(pc.fill_null(texts.slice(k, LINES_AT_ONCE), ""), words.slice(k, LINES_AT_ONCE))


def _placed(texts: pa.Array, words: pa.Array) -> pa.Array:
    of, number, word, size, starts = [0], [], [], [], [np.zeros(0, np.int32)]
    for text, own in zip(texts.to_pylist(), words.to_pylist(), strict=True):
        found = [(k, own[k], s) for k, s in enumerate(occurrences(text, own or [])) if len(s)]
        for k, w, s in found or [(-1, c, np.array([i], np.int32)) for i, c in enumerate(text)]:
            number.append(k)
            word.append(w)
            size.append(len(s))
            starts.append(s)
        of.append(len(number))
    places = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(np.concatenate(starts)))
    items = pa.StructArray.from_arrays([pa.array(number, pa.int32()), pa.array(word, pa.string()), places], ["pair_no", "word", "starts"])
    return pa.ListArray.from_arrays(pa.array(of, pa.int32()), items)


def word_spans(df: DataFrame, text: str, pairs: str) -> DataFrame:
    """Every occurrence of each gloss word in the line: ``df`` with pair_no, word, span_start, span_end (code points).

    See ``word_places``, which gives one row a line.
    """
    each = word_places(df, text, pairs, "_places").select(*df.columns, F.explode_outer("_places").alias("_p")).where("_p is not null")
    hit = each.select(*df.columns, F.col("_p.pair_no").alias("pair_no"), F.col("_p.word").alias("word"), F.explode("_p.starts").alias("span_start"))
    return hit.withColumn("span_end", F.col("span_start") + F.length("word"))


def find_pairs_column(lines: DataFrame, track: str = "track_id", line_no: str = "line_no", value: str = "value") -> DataFrame:
    """Rows (track_id, col, line_no): the first column that looks like a gloss list, by the first line that has one."""
    parts = F.split(value, "\t")
    looks = lambda x: trim_all(x).startswith("[") & x.contains(": ") & ((x.contains("(") & x.contains(")")) | (F.length(x) - F.length(F.replace(x, F.lit('"'), F.lit(""))) >= 2))
    at = F.array_position(F.transform(parts, looks), True).cast("int") - 1
    return lines.select(F.col(track).alias("track_id"), F.col(line_no).alias("line_no"), at.alias("at")).where("at >= 0").groupBy("track_id").agg(F.min_by("at", "line_no").alias("col"), F.min("line_no").alias("line_no"))


def keep_json_string_list(c: Column | str) -> Column:
    """A JSON list of strings, out of its fence and written anew; other text with white space collapsed; empty is ``N/A``."""
    text = trim_all(c)
    bare = F.when(text.startswith("```"), trim_all(F.regexp_replace(text, r"^```(?:json)?\s*|\s*```$", ""))).otherwise(text)
    listed = F.from_json(bare, "array<string>")
    plain = F.regexp_replace(bare, r"(?U)\s+", " ")
    quoted = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+'  # possessive: long lists need no stack
    only = bare.rlike(rf"^\[\s*+(?:{quoted}(?:,\s*+{quoted})*+)?\]$")
    return F.when((bare == "") | bare.isNull(), F.lit("N/A")).when(only & listed.isNotNull(), F.to_json(listed)).otherwise(plain)


def pair_item_for_word(pairs: Column | str, word: Column | str) -> Column:
    """The whole item of ``word``, with one space before its parenthesis; else the list; else ``N/A``."""
    items = F.regexp_extract_all(_col(pairs), F.lit('"([^"]+)"'), F.lit(1))
    head = lambda x: trim_all(F.when(F.instr(x, "(") > 0, F.substring_index(x, "(", 1)).otherwise(F.substring_index(x, ":", 1)))
    own = F.get(F.filter(items, lambda x: head(x) == _col(word)), F.lit(0))
    return F.coalesce(F.regexp_replace(own, r"^([^(]*?)\s*\(", "$1 ("), F.nullif(_col(pairs), F.lit("")), F.lit("N/A"))
