"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueforge.functions import pairs as P
from cueforge.functions import text as T
from cueforge.functions import timecode as C
from cueforge.functions.wrap import wrap_words
from cueforge.plans.registry import query, table
from cueforge.plans.stand_ins import EV, WORDS, cues, glosses

_HMS = "format('{:02d}:{:02d}:{:02d},{:03d}', begin_ms // 3600000, begin_ms // 60000 % 60, begin_ms // 1000 % 60, begin_ms % 1000)"


@query("b1_srt_time", f"with {EV} select pos, {_HMS} as srt, begin_ms as back_ms from ev")
def b1(s, d):
    e = cues(s, d).withColumn("srt", C.ms_to_srt("begin_ms"))
    return e.select("pos", "srt", C.srt_to_ms("srt").alias("back_ms"))


@query("b2_vtt_time", f"""with {EV}, x as (select pos, begin_ms % 3600000 as m from ev)
    select pos, cast(m as bigint) as ms, cast(m // 60000 * 60000 + m // 1000 % 60 * 1000
      + trunc((cast(m % 60000 as double) / 1000 - floor(cast(m % 60000 as double) / 1000)) * 1000) as bigint) as truncated_ms from x""")
def b2(s, d):
    m = F.col("begin_ms") % 3_600_000
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    text = F.concat(two(m / 60_000), F.lit(":"), two(m / 1000 % 60), F.lit("."), F.lpad((m % 1000).cast("string"), 3, "0"))
    return cues(s, d).select("pos", C.vtt_to_ms(text).alias("ms"), C.vtt_to_ms(text, truncate=True, hours=False).alias("truncated_ms"))


@query("b3_secs_time", f"with {EV} select pos, format('{{:d}}.{{:03d}}s', begin_ms // 1000, begin_ms % 1000) as secs, begin_ms as back_ms from ev")
def b3(s, d):
    e = cues(s, d).withColumn("secs", C.ms_to_secs("begin_ms"))
    return e.select("pos", "secs", C.secs_to_ms("secs", True).alias("back_ms"))


@query("b4_ticks", f"""with {EV}, x as (select pos, (pos * 99991 * 2000 + 44100) // 88200 as ms from ev)
    select pos, format('{{:d}}.{{:03d}}s', ms // 1000, ms % 1000) as secs from x""")
def b4(s, d):
    return cues(s, d).select("pos", C.ticks_to_secs(F.concat((F.col("pos") * 99991).cast("string"), F.lit("t")), 44100).alias("secs"))


def _on_documents(name, expr, sql):
    @query(name, f"select doc_id, md5({sql}) as digest, cast(length({sql}) as bigint) as n from documents")
    def run(s, d):
        c = table(s, d, "documents").select("doc_id", expr().alias("c"))
        return c.select("doc_id", F.md5(F.col("c").cast("binary")).alias("digest"), F.length("c").cast("long").alias("n"))


_on_documents("b5_clean_zht", lambda: T.clean_zht("text"), f"regexp_replace(translate(text, '{T.ZHT_DROPPED}', ''), '^\\s+|\\s+$', '', 'g')")
_on_documents("b6_clean_for_speech", lambda: T.clean_for_speech("text"), "trim(translate(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'), '♪♫♬♭♮♯【】[]()（）…', ''))")
_on_documents("b7_strip_punct", lambda: T.strip_punct_for_match("text"), "translate(text, ' 　（）.《》\"', '')")
_on_documents("b8_strip_accents", lambda: T.strip_accents("text", captions=True), f"translate(text, '{T.ACCENTS[0]}', '{T.ACCENTS[1]}')")
_on_documents("b8_pinyin_slug", lambda: T.pinyin_slug("text"), f"translate(replace(translate(text, '{T.TONES[0]}', '{T.TONES[1]}'), ' ', '_'), ':()', '')")


@query("b9_has_script", "select doc_id, regexp_matches(text, '[éèêçñüß]') as has from documents")
def b9(s, d):
    return table(s, d, "documents").select("doc_id", T.has_cjk("text", "[éèêçñüß]").alias("has"))


@query("b10_lang_tag", "select doc_id, case when doc_id % 3 = 2 then '' else lang end as tag from documents")
def b10(s, d):
    ext = F.when(F.col("doc_id") % 3 == 0, ".srt").when(F.col("doc_id") % 3 == 1, ".vtt").otherwise(".txt")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"), ext)
    return table(s, d, "documents").select("doc_id", T.lang_tag(name).alias("tag"))


@query("b11_wrap_words")
def b11(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(wrap_words("text", 480)).alias("line_no", "line"))


@query("b12_split_dialogue", r"""with x as (select conv_id, turn, text, strpos(text, '-') as k from conversations),
    y as (select conv_id, turn, unnest(case when k > 0 then [left(text, k - 1), substr(text, k)] else [text] end) as t from x)
    select conv_id, turn, regexp_replace(t, '^\s+|\s+$', '', 'g') as line from y where regexp_replace(t, '^\s+|\s+$', '', 'g') <> ''""")
def b12(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.explode(T.split_dialogue("text")).alias("line"))


@query("b13_balance_lines", f"""with {WORDS}, x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from wd),
    y as (select *, sum(length(word)) over (partition by doc_id order by p) as c, sum(length(word)) over (partition by doc_id) as n from x),
    z as (select doc_id, any_value(n) as n, greatest(1, count(*) filter (c * 2 <= n + 4)) as k from y group by doc_id),
    l as (select y.doc_id, string_agg(word, '' order by p) filter (z.n <= 12 or p <= k) as a, string_agg(word, '' order by p) filter (z.n > 12 and p > k) as b from y join z on y.doc_id = z.doc_id group by y.doc_id)
    select wd.doc_id, a as first_line, coalesce(b, '') as second_line from wd left join l on wd.doc_id = l.doc_id""")
def b13(s, d):
    g = glosses(s, d).select(F.col("line_no").alias("doc_id"), T.balance_two_lines("w").alias("b"))
    return g.select("doc_id", F.get("b", F.lit(0)).alias("first_line"), F.coalesce(F.get("b", F.lit(1)), F.lit("")).alias("second_line"))


@query("b14_frame_name", """select l_orderkey, l_linenumber, l_partkey, case when length(cast(l_partkey as varchar)) < 4 then lpad(cast(l_partkey as varchar), 4, '0')
    else cast(l_partkey as varchar) end || l_returnflag || '.png' as name from lineitem""")
def b14(s, d):
    name = F.concat(F.col("l_partkey").cast("string"), F.col("l_returnflag"), F.lit(".png"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.pad_frame_name(name).alias("name"))


@query("b15_seek_second", """select o_orderkey, cast(case when o_orderkey > 250 then o_orderkey
    + round_even(o_orderkey * 0.001749577141105422::double + 0.18668641727612567::double, 0) else o_orderkey end as bigint) as second from orders""")
def b15(s, d):
    return table(s, d, "orders").select("o_orderkey", C.seek_second("o_orderkey").cast("long").alias("second"))


_ITEMS = "select line_no, pos, word, pinyin, translation from it"


@query("c1_parse_pairs", f"with {WORDS} {_ITEMS}")
def c1(s, d):
    return glosses(s, d).select("line_no", F.posexplode(P.parse_pairs("pairs_raw")).alias("pos", "p")).select("line_no", "pos", "p.*")


@query("c2_parse_pairs_strict", f"with {WORDS} {_ITEMS}")
def c2(s, d):
    return glosses(s, d).select("line_no", F.posexplode(P.parse_pairs_strict("pairs_raw")).alias("pos", "p")).select("line_no", "pos", "p.*")


@query("c3_format_pairs", f"with {WORDS} select line_no, pairs_raw as printed from gl")
def c3(s, d):
    return glosses(s, d).select("line_no", P.format_pairs(P.parse_pairs("pairs_raw")).alias("printed"))


@query("c4_pair_words", f"with {WORDS} select line_no, word from it")
def c4(s, d):
    return glosses(s, d).select("line_no", F.explode(P.pair_words("pairs_raw")).alias("word"))


#: The last word that heads a gloss of the line, and the line's second word, which may head one too.
_LAST = "ls as (select line_no, pairs_raw, w[(len(w) - 1) // 3 * 3 + 1] as a, w[2] as b from gl)"


def _last():
    return F.expr("get(w, cast((size(w) - 1) div 3 * 3 as int))")


@query("c5_lookup_pinyin", f"""with {WORDS}, {_LAST} select ls.line_no, coalesce(f.pinyin, a) as pinyin, coalesce(g.pinyin, b) as own
    from ls left join fi f on f.line_no = ls.line_no and f.word = a left join fi g on g.line_no = ls.line_no and g.word = b""")
def c5(s, d):
    g = glosses(s, d).withColumn("a", _last())
    return g.select("line_no", P.lookup_pinyin("a", "pairs_raw").alias("pinyin"), P.lookup_pinyin(F.get("w", F.lit(1)), "pairs_raw").alias("own"))


@query("c6_segment_longest_match")
def c6(s, d):
    g = glosses(s, d).select("line_no", F.array_join("w", "").alias("line"), P.parse_pairs("pairs_raw").alias("pairs"))
    return g.select("line_no", F.posexplode(P.segment_longest_match("line", "pairs")).alias("pos", "x")).select("line_no", "pos", "x.*")


@query("c7_word_spans", f"""with {WORDS}, x as (select gl.line_no, pos, word, array_to_string(w, ' ') as t from gl join it on gl.line_no = it.line_no)
    select line_no, pos as pair_no, cast((length(t) - length(replace(t, word, ''))) // length(word) as bigint) as spans, strpos(t, word) - 1 as first_start from x""")
def c7(s, d):
    g = glosses(s, d).select("line_no", F.array_join("w", " ").alias("t"), "pairs_raw")
    places = P.word_places(g, "t", "pairs_raw").select("line_no", F.explode_outer("places").alias("p")).where("p is not null")
    return places.select("line_no", "p.pair_no", F.size("p.starts").cast("long").alias("spans"), F.array_min("p.starts").cast("long").alias("first_start"))


@query("c8_find_pairs_column", f"with {WORDS} select distinct track_id, 2 as col from gl where len(w) > 0")
def c8(s, d):
    g = glosses(s, d).select("track_id", "line_no", F.concat_ws("\t", F.col("line_no").cast("string"), F.array_join("w", " "), "pairs_raw").alias("value"))
    return P.find_pairs_column(g).select("track_id", "col")


@query("c9_keep_json_list", f"""with {WORDS} select line_no, case when line_no % 3 = 0 then '["' || coalesce(array_to_string(w, '","'), '') || '"]' when line_no % 3 = 1 and len(w) > 0 then array_to_string(w, ' ') else 'N/A' end as kept from gl""")
def c9(s, d):
    g = glosses(s, d)
    raw = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit('```json\n["'), F.array_join("w", '", "'), F.lit('"]\n```'))).when(F.col("line_no") % 3 == 1, F.array_join("w", " \n ")).otherwise(" ")
    return g.select("line_no", P.keep_json_string_list(raw).alias("kept"))


@query("c10_pair_item_for_word", f"""with {WORDS}, {_LAST} select ls.line_no, coalesce(f.word || ' (' || f.pinyin || '): ' || f.translation, pairs_raw) as item from ls left join fi f on f.line_no = ls.line_no and f.word = a""")
def c10(s, d):
    g = glosses(s, d).withColumn("a", _last())
    return g.select("line_no", P.pair_item_for_word("pairs_raw", "a").alias("item"))


@query("b15_seek_frame", """select o_orderkey, cast(floor(cast(case when o_orderkey > 250 then o_orderkey
    + round_even(o_orderkey * 0.001749577141105422::double + 0.18668641727612567::double, 0) else o_orderkey end as double) * 23.976::double) as bigint) as frame from orders""")
def b15_frame(s, d):
    return table(s, d, "orders").select("o_orderkey", C.seek_frame("o_orderkey", 23.976).alias("frame"))


@query("h4_html_to_text", "select page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) as digest from pages")
def h4(s, d):
    return table(s, d, "pages").select("page_id", F.md5(T.html_to_text("html").cast("binary")).alias("digest"))
