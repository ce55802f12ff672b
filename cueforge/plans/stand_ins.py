"""Cue, gloss and file tables derived from the given tables, in Spark and as SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueforge.plans.registry import spread, table

#: Events as cues: a track for each user, times since 2024-01-01, lengths of value minutes.
EV = """ev as (select cast(user_id as varchar) as track_id, event_id as pos, epoch_us(ts) // 1000 - 1704067200000 as begin_ms,
    epoch_us(ts) // 1000 - 1704067200000 + cast(round(value * 60000) as bigint) as end_ms, event_type as text from events)"""


def cues(spark: SparkSession, d: str) -> DataFrame:
    begin = F.expr("timestampdiff(MILLISECOND, timestamp_ntz '2024-01-01 00:00:00', ts)")
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("track_id"), F.col("event_id").alias("pos"), begin.alias("begin_ms"), F.round(F.col("value") * 60000).cast("long").alias("_n"), F.col("event_type").alias("text"))
    return e.select("track_id", "pos", "begin_ms", (F.col("begin_ms") + F.col("_n")).alias("end_ms"), "text")


#: All words of every document (``wd``), a line for each document with one gloss for every three words (``gl``), the glosses
#: one by one (``it``), and the first of each word in a line (``fi``). A hundred documents are a track.
WORDS = r"""wd as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
  gs as (select cast(doc_id // 100 as varchar) as track_id, doc_id as line_no, w, list_transform(range(0, (len(w) + 2) // 3), lambda i: {'pos': cast(i as integer), 'word': w[3 * i + 1], 'pinyin': coalesce(w[3 * i + 2], 'x'), 'translation': coalesce(w[3 * i + 3], 'y')}) as g from wd),
  gl as (select track_id, line_no, w, '[' || coalesce(array_to_string(list_transform(g, lambda x: '"' || x.word || ' (' || x.pinyin || '): ' || x.translation || '"'), ', '), '') || ']' as pairs_raw from gs),
  it as (select track_id, line_no, x.pos, x.word, x.pinyin, x.translation from (select track_id, line_no, unnest(g) as x from gs)),
  fi as (select line_no, word, min_by(pinyin, pos) as pinyin, min_by(translation, pos) as translation from it group by line_no, word)"""


def glosses(spark: SparkSession, d: str) -> DataFrame:
    """Rows (track_id, line_no, w, pairs_raw) of all documents: every word, and one gloss for every three."""
    w = F.expr(r"filter(split(coalesce(text, ''), '[^\\p{L}\\p{N}]+'), x -> x <> '')")
    item = "concat('\"', v[3 * i], ' (', coalesce(get(v, 3 * i + 1), 'x'), '): ', coalesce(get(v, 3 * i + 2), 'y'), '\"')"
    places = "if(size(v) = 0, cast(array() as array<int>), sequence(0, cast((size(v) - 1) div 3 as int)))"
    g = spread(table(spark, d, "documents").select("doc_id", "text")).select(F.expr("cast(doc_id div 100 as string)").alias("track_id"), F.col("doc_id").alias("line_no"), w.alias("w"))
    return g.withColumn("pairs_raw", F.expr(f"element_at(transform(array(w), v -> concat('[', array_join(transform({places}, i -> {item}), ', '), ']')), 1)"))


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Every word that heads a gloss, with a confidence by its length."""
    g = glosses(spark, d).select(F.explode_outer(F.expr("filter(w, (x, i) -> i % 3 = 0)")).alias("word")).where("word is not null").distinct()
    return g.select("word", F.lit("").alias("pinyin"), F.lit("").alias("translation"), (F.length("word") % 4).alias("confidence_level"))


#: Chunk files of line items: a folder an order, the stage by the line's status.
FILES = """fl as (select cast(l_orderkey as varchar) as folder, 'v_chunk_' || lpad(cast(l_linenumber as varchar), 3, '0')
    || case when l_linestatus = 'F' then '_processed' else '' end || '.mp4' as name, cast(l_quantity as bigint) as size from lineitem)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    name = F.concat(F.lit("v_chunk_"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.when(F.col("l_linestatus") == "F", "_processed").otherwise(""), F.lit(".mp4"))
    return li.select(F.col("l_orderkey").cast("string").alias("folder"), name.alias("name"), F.col("l_quantity").cast("long").alias("size"))


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder for derived files, in the shared folder of the session if it has one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="cueforge-")
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"
