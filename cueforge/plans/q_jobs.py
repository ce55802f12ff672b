"""Queries of the pipelines and of the streaming jobs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.functions.text import ZHT_DROPPED
from cueforge.operators import translate
from cueforge.plans import pipelines, q_cues
from cueforge.plans.q_cues import KEPT, MERGED as _MERGED_SQL, _upper, digest, two_tracks
from cueforge.plans.registry import query, table
from cueforge.plans.stand_ins import EV, WORDS, cues, glosses, lexicon, scratch
from cueforge.streaming import jobs


@query("p1_build_base", f"with {_MERGED_SQL} select track_id, cast(row_number() over (partition by track_id order by begin_ms, pos) as integer) as idx, begin_ms, end_ms, text as zht, 'N/A' as pairs_raw, match as pt from al")
def p1(s, d):
    a, o = two_tracks(s, d)
    return pipelines.build_base(a, o).select("track_id", "idx", "begin_ms", "end_ms", "zht", "pairs_raw", "pt")


def _lines(s, d):
    g = glosses(s, d)
    begin = F.col("line_no") * 4000
    return g.select("track_id", "line_no", begin.alias("begin_ms"), (begin + 900).alias("end_ms"), F.concat(F.lit("【字】x"), F.translate(F.array_join("w", " "), ZHT_DROPPED, "")).alias("zht"), "pairs_raw")


@query("p2_prepare_episode_base", f"""with {KEPT}, t as (select track_id, line_no, line_no * 4000 as b, least(line_no * 4000 + 60900, coalesce(lead(line_no) over (partition by track_id order by line_no) * 4000 - 1, line_no * 4000 + 60900)) as e,
      regexp_replace('字' || translate(coalesce(array_to_string(w, ' '), ''), '{ZHT_DROPPED}', ''), '^\\s+|\\s+$', '', 'g') as zht from gl)
    select track_id, t.line_no, b // 30000 as chunk_no, b % 30000 as begin_ms, b % 30000 + e - b as end_ms, md5(zht) as digest, '[' || coalesce(kept, '') || ']' as pairs_raw
    from t left join kp on t.line_no = kp.line_no where kept is not null or n is null""")
def p2(s, d):
    rows, _ = _prepared(s, d, lexicon(s, d))
    return rows.select("track_id", "line_no", "chunk_no", "begin_ms", "end_ms", F.md5(F.col("zht").cast("binary")).alias("digest"), "pairs_raw")


def _prepared(s, d, known):
    lines = _lines(s, d)
    long = lines.groupBy("track_id").agg((F.max("begin_ms") + 4000).alias("duration_ms"))
    return pipelines.prepare_episode_base(lines, known, long, empty=False)


@query("p2_new_entries", f"""with {WORDS}, r as (select *, row_number() over (partition by word order by track_id, line_no, pos) as k from it)
    select word, pinyin, translation, 1 as confidence_level from r where k = 1 and length(word) > 7""")
def p2_entries(s, d):
    return _prepared(s, d, lexicon(s, d).where("length(word) <= 7"))[1]


@query("p3_vocabulary_totals", f"with {WORDS} select count(*) as total, count(distinct word) as words from it")
def p3(s, d):
    return pipelines.vocabulary_report(glosses(s, d))[1]


@query("p3_vocabulary_counts", f"with {WORDS} select word, count(*) as n from it group by word")
def p3_counts(s, d):
    return pipelines.vocabulary_report(glosses(s, d))[0]


def _gloss(text: str) -> str:
    word = re.search("[A-Za-z0-9]+", text)
    return f'["{word[0]} (x): y"]' if word else "[]"


@query("p4_text_study_base", r"""with x as (select conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) as n, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') as value from conversations),
    y as (select *, regexp_extract(value, '[A-Za-z0-9]+') as w from x where regexp_matches(value, '[éèêçñüß]'))
    select conv_id, turn, n, md5(value) as digest, case when w = '' then '[]' else '["' || w || ' (x): y"]' end as pairs_raw, sha256(value) as translation from y where length(w) <> 5""")
def p4(s, d):
    lines = table(s, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "value")).withColumn("n", F.col("n").cast("long") + 1)
    known = lines.select(F.regexp_extract("value", "[A-Za-z0-9]+", 0).alias("word")).where("length(word) = 5").distinct().withColumns({"confidence_level": F.lit("3")})
    out = pipelines.text_study_base(lines, _gloss, digest, known, "[éèêçñüß]", ("conv_id", "turn", "n"))
    return out.select("conv_id", "turn", "n", F.md5(F.col("value").cast("binary")).alias("digest"), "pairs_raw", "translation")


@query("p5_vtt_to_srt", f"""with {EV}, n as (select *, row_number() over (partition by track_id order by pos) as k, begin_ms % 3600000 as b from ev)
    select track_id, md5(string_agg(k || chr(10) || format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', 0, b // 60000 % 60, b // 1000 % 60, b % 1000) || ' --> ' || format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', (b + 700) // 3600000, (b + 700) // 60000 % 60, (b + 700) // 1000 % 60, (b + 700) % 1000) || chr(10) || text || chr(10), chr(10) order by k)) as digest from n group by track_id""")
def p5(s, d):
    e = cues(s, d).withColumn("begin_ms", F.col("begin_ms") % 3_600_000).withColumn("end_ms", F.col("begin_ms") + 700)
    return pipelines.vtt_to_srt(e).select("track_id", F.md5(F.col("content").cast("binary")).alias("digest"))


_PHRASES = [("the", "teh"), ("teh an", "thean"), ("sch", "sh"), ("ión", "ion")]


@query("p6_to_traditional", "select conv_id, turn, md5(replace(replace(replace(replace(text, 'the', 'teh'), 'teh an', 'thean'), 'sch', 'sh'), 'ión', 'ion')) as digest from conversations")
def p6(s, d):
    return pipelines.to_traditional(table(s, d, "conversations"), _PHRASES).select("conv_id", "turn", F.md5(F.col("traditional").cast("binary")).alias("digest"))


_LETTERS = r"'[^\p{L}]+'"


@query("p6_phrase_table", f"""with p as (select distinct w from (select unnest(regexp_split_to_array(lower(text), {_LETTERS})) as w from benchmark) where length(w) > 2),
    t as (select list({{'old': w, 'new': reverse(w)}} order by w) as l from p)
    select conv_id, turn, md5(list_reduce(list_prepend({{'old': text, 'new': ''}}, l), lambda a, x: {{'old': replace(a.old, x.old, x.new), 'new': ''}}).old) as digest from conversations, t""")
def p6_table(s, d):
    """Every word of the benchmark, in alphabetical order, turned round wherever it occurs."""
    words = table(s, d, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("phrase")).where("length(phrase) > 2").distinct()
    phrases = words.select(F.lit(0).alias("dict_order"), "phrase", F.reverse("phrase").alias("translation"))
    return pipelines.to_traditional(table(s, d, "conversations"), phrases).select("conv_id", "turn", F.md5(F.col("traditional").cast("binary")).alias("digest"))


@query("p7_translate_track", f"""with {EV}, old as (select track_id, begin_ms from ev where pos % 4 = 0)
    select track_id, begin_ms, max(end_ms) as end_ms, reverse(upper(min_by(text, pos))) as text from ev e
    where not exists (select 1 from old o where o.track_id = e.track_id and o.begin_ms = e.begin_ms) group by track_id, begin_ms""")
def p7(s, d):
    e = cues(s, d)
    return pipelines.translate_track(e, e.where("pos % 4 = 0"), _upper)


#: Parts of the input in order of time, and files of each: what a stream of files over time looks like.
_PARTS, _FILES = 4, 4


def _streamed(s, df: DataFrame, time: str, key: str) -> DataFrame:
    """``df`` as a stream of files that come in ``_PARTS`` steps of ``time``, each as files dealt by ``key``; every micro-batch takes the files of a step at most."""
    path = scratch(s, "stream-in")
    low, high = df.agg(F.min(time), F.max(time)).first()
    step = [low + (high - low) * k / _PARTS for k in range(_PARTS)] if low is not None else [None]
    step = [int(x) if isinstance(low, int) else x for x in step if x is not None]
    for k, begin in enumerate(step):
        part = df.where(F.col(time) >= F.lit(begin)) if k + 1 == len(step) else df.where((F.col(time) >= F.lit(begin)) & (F.col(time) < F.lit(step[k + 1])))
        part.repartition(_FILES, key).write.parquet(f"{path}/{k}")
    if not step:
        df.write.parquet(f"{path}/0")
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", _FILES).parquet(f"{path}/*")


def _drained(s, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream writes until its input is used up; of a complete result what the last batch has."""
    out, marks = scratch(s, "stream-out"), scratch(s, "stream-marks")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return s.read.parquet(out)
    stream.writeStream.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out)


@query("s1_stream_new_cues", f"with {EV} select distinct track_id, begin_ms from ev")
def s1(s, d):
    return _drained(s, jobs.stream_new_cues(_streamed(s, cues(s, d), "begin_ms", "track_id")), "append").select("track_id", "begin_ms")


@query("s2_stream_word_counts", f"with {WORDS} select word, count(*) as n from it group by word")
def s2(s, d):
    return _drained(s, jobs.stream_word_counts(_streamed(s, glosses(s, d).select("line_no", "pairs_raw"), "line_no", "line_no")), "complete")


def _timed(s, d, name: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("event_type").alias(name), "user_id", "ts")
    return e.withColumn("ts", F.timestamp_millis(F.expr("timestampdiff(MILLISECOND, timestamp_ntz '1970-01-01 00:00:00', ts)")))


#: Files of a step come in any order, so the watermark allows for the length of two steps.
@query("s3_stream_chunks", """with x as (select event_type as track_id, time_bucket(interval '1 hour', ts) as b, count(*) as cues from events group by 1, 2)
    select track_id, epoch_ms(b) // 1000 as chunk_start_s, cues from x where b + interval '1 hour' <= (select max(ts) - interval '15 days' from events)""")
def s3(s, d):
    out = _drained(s, jobs.stream_chunks(_streamed(s, _timed(s, d, "track_id"), "ts", "user_id"), 3_600_000, "15 days"), "append")
    return out.select("track_id", F.unix_seconds("chunk_start").alias("chunk_start_s"), "cues")


@query("s4_stream_dedupe", "select distinct user_id as id from events")
def s4(s, d):
    return _drained(s, jobs.stream_dedupe(_streamed(s, _timed(s, d, "kind").withColumnRenamed("user_id", "id"), "ts", "kind"), "id", "3650 days"), "append").select("id")


def _closed(df: DataFrame, days: int) -> DataFrame:
    """``df`` with a cue so much later that all others can come out of a stream."""
    last = df.agg((F.max("begin_ms") + days * 86_400_000).alias("begin_ms")).where("begin_ms is not null")
    return df.unionByName(last.select(F.lit("~end").alias("track_id"), F.lit(-1).cast("long").alias("pos"), "begin_ms", (F.col("begin_ms") + 1).alias("end_ms"), F.lit("end").alias("text")))


@query("e1_stream_align", q_cues.ALIGNED)
def e1_stream(s, d):
    """The two tracks of ``e1_align_tracks`` as two streams."""
    a, o = (_streamed(s, _closed(x, 60), "begin_ms", "track_id") for x in two_tracks(s, d))
    return _drained(s, jobs.stream_align(a, o, "20 days", "1 day"), "append").select("track_id", "pos", "begin_ms", "end_ms", "text", "match")


@query("f3_lasting_answers", "select conv_id, turn, sha256(text) as digest from conversations")
def f3_lasting(s, d):
    """Answers in a table that a second run reads: the first run asks for what users say."""
    c, cache = table(s, d, "conversations"), scratch(s, "answers")
    translate.cached_enrichment(c.where("role = 'user'"), "text", digest, cache, "sha256")
    return translate.cached_enrichment(c, "text", digest, cache, "sha256").select("conv_id", "turn", F.col("enriched").alias("digest"))
