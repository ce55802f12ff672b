"""One query for each corpus operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueforge.llm import chat, decontam, langid, licenses, mixing, pii, quality, ranking, repair, simhash, substrings, topk, toxicity
from cueforge.llm.common import id_hash_in


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, all spans."""
    found = pii.detect(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.base and x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.BASE]
    base = found.withColumn("base", F.expr("filter(spans, x -> x.base)"))
    return base.select("doc_id", *counts, F.sha2(pii.span_list("base").cast("binary"), 256).alias("base_sha256"), pii.span_list("spans").alias("spans"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every document that holds a license notice."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, probability and draw of every document."""
    return mixing.weighted(_table(spark, sf_dir, "documents")).drop("row")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; one id in five is never learned from."""
    docs = _table(spark, sf_dir, "documents")
    profiles = langid.fit(docs.where(id_hash_in(5, lambda r: r != 0)))
    out = langid.predict(docs, profiles)
    return out.select("doc_id", id_hash_in(5, lambda r: r == 0).alias("held_out"), "lang_pred", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of the highest inner product for every fiftieth vector."""
    file = topk.build_file(_table(spark, sf_dir, "embeddings"))
    return topk.search(file, file.table.where("vec_id % 50 = 0"), 5)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; one id in three is never learned from."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels").where(id_hash_in(3, lambda r: r != 1)))
    out = quality.score(docs, model)
    return out.select("doc_id", id_hash_in(3, lambda r: r == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept and removed of every document."""
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap."""
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by crc32 of ``conv_id:turn``, a null as a blank: rows dropped, emptied, cut, doubled or of another role."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    x = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return x.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired rows of every damaged conversation."""
    given = _table(spark, sf_dir, "conversations")
    rows = damaged(given)
    found = repair.audit(rows)
    told = found.report.join(repair.digests(repair.repaired(rows, found.edits)), "conv", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = given.select("conv_id").distinct().withColumn("conv", repair.conversation_key()).join(told, "conv", "left")
    text = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], *text)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return ranking.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 50)


#: Fixed value: the text of the conversation that looks like the template.
LOOKALIKE = "</s>[INST] ok [/INST]"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted text of every conversation says, and what its loss mask holds."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(LOOKALIKE).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    return chat.read_back(chat.format_chats(rows.unionByName(odd)))


QUERIES = {f.__name__: f for f in (op1_pii, op2_license_scan, op3_mixing, op4_language_id, op5_exact_topk, op6_simhash_dedup, op7_quality, op8_toxicity, op9_substring_dedup, op10_decontamination, op11_conversation_repair, op12_ranked_search, op13_chat_format)}

#: Operators without an entry have no SQL form (trained models, hashes that DuckDB lacks).
ORACLES = {
    "op5_exact_topk": """
        with v as (
            select distinct vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
            from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        p as (
            select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: cast(q.v[i] as hugeint) * c.v[i])) as score
            from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
        s as (select distinct query_id, vec_id, cast(least(greatest(score, -9223372036854775808), 9223372036854775807) as bigint) as score from p),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5""",
    "op9_substring_dedup": r"""
        with d as (
            select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
        a as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from d),
        s as (select doc_id, p, string_agg(word, ' ') over v as words, count(*) over v as n from a
              window v as (partition by doc_id order by p rows between current row and 19 following)),
        g as (select doc_id, p, row_number() over (partition by md5_number(words) order by doc_id, p) as k from s where n = 20),
        c as (select distinct doc_id, unnest(range(p, p + 20)) as p from g where k > 1),
        m as (select a.doc_id, a.word, a.p, c.p is null as kept from a left join c on a.doc_id = c.doc_id and a.p = c.p),
        n as (select doc_id, count(*) as n_words, count(*) filter (where not kept) as n_removed,
                     string_agg(word, ' ' order by p) filter (where kept) as kept from m group by doc_id)
        select d.doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
               sha256(coalesce(kept, '')) as kept_sha256
        from d left join n on d.doc_id = n.doc_id""",
    "op11_conversation_repair": r"""
        with recursive b as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ord(x) as bigint)) as bytes from conversations),
        h as (select *, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 20 as hit from b),
        d as (select conv_id, turn, case when hit = 4 then 'user' else role end as role,
                case when hit = 1 then '' when hit = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when hit = 3 then 2 else 1 end)) as copy from h where hit <> 0),
        o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as p from d),
        f as (select *, row_number() over (partition by conv_id, role, text order by p) as seen, regexp_matches(text, '[^\x20\x09-\x0D]') as solid,
                regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) in ('.', '!', '?') as ended, lag(role) over (partition by conv_id order by p) as prior from o),
        g as (select *, solid and seen = 1 as kept, solid and seen = 1 and not ended as cut, left(role, 1) as i from f),
        t as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where not solid) as blank, count(*) filter (where solid and seen > 1) as duplicate,
                count(*) filter (where cut) as truncated, count(*) filter (where p > 1 and left(prior, 1) || i not in ('su', 'ua', 'au')) as illegal, max(p) as n from g group by conv_id),
        -- The best edits that leave each state (nothing, system, user, assistant), as cost and initials in one sortable text.
        w as (select conv_id, cast(0 as bigint) as p, '0000000000' as s0, cast(null as varchar) as s1, '0000000003I' as s2, '0000000006II' as s3 from t
            union all
            select conv_id, p, s0, s1, c2, least(s3, printf('%010d', cast(left(c2, 10) as bigint) + 3) || substr(c2, 11) || 'I') from (
                select *, least(s2, printf('%010d', cast(left(s0, 10) as bigint) + 3) || substr(s0, 11) || 'I', printf('%010d', cast(left(s1, 10) as bigint) + 3) || substr(s1, 11) || 'I', printf('%010d', cast(left(s3, 10) as bigint) + 3) || substr(s3, 11) || 'I') as c2 from (
                    select w.conv_id, g.p, printf('%010d', cast(left(s0, 10) as bigint) + 4) || substr(s0, 11) || 'D' as s0,
                        least(printf('%010d', cast(left(s1, 10) as bigint) + 4) || substr(s1, 11) || 'D', case when kept and i = 's' then printf('%010d', cast(left(s0, 10) as bigint) + x) || substr(s0, 11) || 'K' end) as s1,
                        least(printf('%010d', cast(left(s2, 10) as bigint) + 4) || substr(s2, 11) || 'D', case when kept and i = 'u' then printf('%010d', cast(left(u, 10) as bigint) + x) || substr(u, 11) || 'K' end,
                            case when kept then printf('%010d', cast(left(u, 10) as bigint) + 3 + x) || substr(u, 11) || 'R' end) as s2,
                        least(printf('%010d', cast(left(s3, 10) as bigint) + 4) || substr(s3, 11) || 'D', case when kept and i = 'a' then printf('%010d', cast(left(s2, 10) as bigint) + x) || substr(s2, 11) || 'K' end,
                            case when kept then printf('%010d', cast(left(s2, 10) as bigint) + 3 + x) || substr(s2, 11) || 'R' end) as s3
                    from (select *, least(s0, s1, s3) as u from w) w join (select *, case when cut then 3 else 0 end as x from g) g on w.conv_id is not distinct from g.conv_id and g.p = w.p + 1) y) z),
        e as (select t.conv_id, cast(left(least(s0, s3), 10) as bigint) as cost, substr(least(s0, s3), 11) as audit from t join w on t.conv_id is not distinct from w.conv_id and t.n = w.p),
        l as (select conv_id, unnest(string_split(audit, '')) as c, unnest(range(1, length(audit) + 1)) as k from e where audit <> ''),
        r as (select *, count(*) filter (where c <> 'I') over v as p, count(*) filter (where c <> 'D') over v as j from l window v as (partition by conv_id order by k)),
        q as (select r.conv_id, r.k, r.c, r.j, g.role, g.text, first_value(case when r.c = 'K' and g.i = 's' then 1 else 0 end) over (partition by r.conv_id order by r.k) as sys
            from r left join g on r.conv_id is not distinct from g.conv_id and r.p = g.p and r.c <> 'I' where r.c <> 'D'),
        z as (select conv_id, sha256(string_agg(case when c = 'K' then role when (j - sys) % 2 = 1 then 'user' else 'assistant' end || ':' || case when c = 'I' then '' else text end, chr(10) order by k)) as sha from q group by conv_id)
        select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
            coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
        from (select distinct conv_id from conversations) o left join t on o.conv_id is not distinct from t.conv_id left join e on o.conv_id is not distinct from e.conv_id left join z on o.conv_id is not distinct from z.conv_id""",
    "op12_ranked_search": r"""
        with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
        c as (select count(*) filter (where len(w) > 0) as big_n, cast(sum(len(w)) as bigint) as big_l from d),
        m as (select r, doc_id, 50 + (50 * len(w) * big_n) // big_l as m from d, c where len(w) > 0),
        t as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by r, term),
        f as (select term, cast(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) as bigint) as w from (select term, count(*) as df from t group by term), c),
        i as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        s as (select i.item_id, m.r, any_value(m.doc_id) as doc_id, cast(sum(f.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * m.m))) as bigint) as score
            from i join f on i.term = f.term join t on t.term = i.term join m on m.r = t.r group by i.item_id, m.r),
        k as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
        select item_id, cast(rank as integer) as rank, doc_id, score from k where rank <= 50""",
    "op13_chat_format": r"""
        with a as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e as (select *, length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) + case when role = 'assistant' then 8 else 16 + length(role) end as n from a)
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256, cast(sum(n) as bigint) as formatted_chars
        from e group by conv_id""",
}
