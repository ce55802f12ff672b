"""Translation by phrase tables and by an injected model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueforge.functions.matching import Rewriter, automaton

#: Phrase tables of up to so many rows and bytes are one automaton, which every task builds.
AUTOMATON_PHRASES, AUTOMATON_BYTES = 20_000, 1 << 20


def translate_by_dictionary(df: DataFrame, dictionary: DataFrame, text: str = "text", mode: str = "value", out: str = "translation") -> DataFrame:
    """``df`` with ``out``: the exact phrase's translation, else that of the first phrase contained in the text.

    ``mode='replace'`` puts the contained phrase's translation in its place. Without any phrase
    ``[Traduzir: …]``. ``dictionary(dict_order, phrase, translation)``; each distinct text is looked up once.
    Phrases within ``AUTOMATON_PHRASES`` and ``AUTOMATON_BYTES`` are found in one pass over a text; in a larger table, a text and a phrase
    meet by an equi-join on the first 8 (4, 2, 1, for shorter ones) characters of the phrase, which a text that contains it holds, and the whole
    phrase decides. A null text has a null translation.
    """
    d = dictionary.select("dict_order", "phrase", "translation").where("phrase <> ''")
    texts = df.select(F.col(text).alias("_t")).where("_t is not null").distinct()
    rows, size = d.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    first = _first_by_automaton(texts, d) if rows <= AUTOMATON_PHRASES and size <= AUTOMATON_BYTES else _first_by_join(texts, d)
    told = F.col("h.translation") if mode == "value" else F.when(F.col("h.part"), F.replace("_t", F.col("h.phrase"), F.col("h.translation"))).otherwise(F.col("h.translation"))
    return df.join(first.select(F.col("_t").alias(text), told.alias(out)), text, "left").withColumn(out, F.coalesce(out, F.concat(F.lit("[Traduzir: "), F.col(text), F.lit("]")))).select(*df.columns, out)


def _first_by_automaton(texts: DataFrame, d: DataFrame) -> DataFrame:
    """Rows (_t, h): the phrase that counts for each text that has one."""
    table = [tuple(r) for r in d.orderBy("dict_order", "phrase", "translation").collect()]
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [p for _, p, _ in sent.value]
        machine, whole = automaton(phrases), {p: k for k, p in reversed(list(enumerate(phrases)))}
        for batch in batches:
            made = []
            for t in batch.column("_t").to_pylist() if machine else ():
                k = whole[t] if t in whole else min((k for _, k in machine.iter(t)), default=None)
                if k is not None:
                    made.append({"_t": t, "h": {"part": t != phrases[k], "phrase": phrases[k], "translation": sent.value[k][2]}})
            yield pa.RecordBatch.from_pylist(made, pa.schema([("_t", pa.string()), ("h", pa.struct([("part", pa.bool_()), ("phrase", pa.string()), ("translation", pa.string())]))]))

    return texts.mapInArrow(run, "_t string, h struct<part:boolean,phrase:string,translation:string>")


def _first_by_join(texts: DataFrame, d: DataFrame) -> DataFrame:
    """As ``_first_by_automaton``, for tables of any size."""
    n = F.when(F.length("phrase") >= 8, 8).when(F.length("phrase") >= 4, 4).when(F.length("phrase") >= 2, 2).otherwise(1)
    d = d.withColumn("_n", n).withColumn("_g", F.expr("left(phrase, _n)"))
    chars = texts.withColumn("_c", F.regexp_extract_all("_t", F.lit("(?s)."), F.lit(0)))
    grams = [f"transform(if(size(_c) < {k}, cast(array() as array<int>), sequence(1, size(_c) - {k - 1})), i -> named_struct('_n', {k}, '_g', array_join(slice(_c, i, {k}), '')))" for k in (1, 2, 4, 8)]
    keyed = chars.select("_t", F.explode_outer(F.array_distinct(F.expr(f"concat({', '.join(grams)})"))).alias("_k")).select("_t", "_k.*")
    hit = keyed.join(d, ["_n", "_g"]).where(F.col("_t").contains(F.col("phrase")))
    return hit.groupBy("_t").agg(F.min(F.struct((F.col("_t") != F.col("phrase")).alias("part"), "dict_order", "phrase", "translation")).alias("h"))


def replace_phrases(df: DataFrame, phrases: DataFrame | list[tuple[str, str]], text: str = "text", out: str = "traditional") -> DataFrame:
    """``df`` with ``out``: the phrases replaced one after another, in order; what one makes, a later one sees.

    ``phrases(dict_order, phrase, translation)`` of any number (ties in order of phrase, then translation), or a list of (old, new). The table is cut in
    order into parts of at most ``AUTOMATON_PHRASES`` and about ``AUTOMATON_BYTES``, each one pass over the texts: only phrases that occur
    in a text cost anything there. Empty and null phrases are left out, a null translation is empty, a null text stays null.
    """
    if isinstance(phrases, DataFrame):
        listed = phrases.where("phrase <> ''").select("dict_order", "phrase", F.coalesce("translation", F.lit("")).alias("translation")).orderBy("dict_order", "phrase", "translation").select("phrase", "translation").toLocalIterator(prefetchPartitions=True)
    else:
        listed = ((old, new) for old, new in phrases if old)
    done = df.withColumn(out, F.col(text))
    for part in _parts(listed):
        done = _rewritten(done, out, df.sparkSession.sparkContext.broadcast(part))
    return done


def _parts(phrases: Iterable[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    """Consecutive phrases within the bounds of one automaton."""
    part: list[tuple[str, str]] = []
    size = 0
    for old, new in phrases:
        more = len(old.encode()) + len(new.encode())
        if part and (len(part) >= AUTOMATON_PHRASES or size + more > AUTOMATON_BYTES):
            yield part
            part, size = [], 0
        part.append((old, new))
        size += more
    if part:
        yield part


def _rewritten(df: DataFrame, column: str, sent) -> DataFrame:
    @F.arrow_udf("string")
    def rewrite(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rewriter = Rewriter(sent.value)
        for texts in batches:
            yield pa.array(map(rewriter, texts.to_pylist()), pa.string())

    return df.withColumn(column, rewrite(column))


def distinct_enrichment(df: DataFrame, text_col: str, fn: Callable[[str], str], out: str = "enriched", retries: int = 3, base_delay: float = 2.0, parallelism: int | None = None, permanent: tuple[type[Exception], ...] = (ValueError,)) -> DataFrame:
    """``df`` with ``out`` = ``fn(text)``, called once for each distinct text.

    A failing call is retried with doubled delays, errors in ``permanent`` are not; a text that
    keeps failing gives null. ``parallelism`` bounds the concurrent calls. Write the result before
    using it twice if ``fn`` is costly.
    """

    def call(text: str) -> str | None:
        for k in range(retries + 1):
            try:
                return fn(text)
            except permanent:
                return None
            except Exception:
                if k < retries:
                    time.sleep(base_delay * 2**k)
        return None

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_t": batch["_t"], out: [call(t) for t in batch["_t"]]})

    texts = df.select(F.col(text_col).alias("_t")).where("_t is not null").distinct()
    texts = texts.repartition(parallelism, "_t") if parallelism else texts
    done = texts.mapInPandas(rows, f"_t string, `{out}` string")
    return df.join(done.withColumnRenamed("_t", text_col), text_col, "left").select(*df.columns, out)


ANSWERS = "model string, key string, answer string, error string, attempts int, tried_at double, next_try double"


def _known_answers(spark: SparkSession, cache: str, model: str) -> DataFrame:
    """Rows (key, answer, attempts, next_try): the last that is known of each text, answers before failures."""
    try:
        stored = spark.read.schema(ANSWERS).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], ANSWERS)
    last = F.struct(F.col("answer").isNotNull().alias("told"), "tried_at", "attempts", "answer", "next_try")
    return stored.where(F.col("model") == model).groupBy("key").agg(F.max(last).alias("r")).select("key", "r.answer", "r.attempts", "r.next_try")


def cached_enrichment(df: DataFrame, text_col: str, fn: Callable[[str], str], cache: str, model: str, out: str = "enriched", rounds: int = 1, parallelism: int | None = None, per_second: float | None = None, retry_after_s: float = 60.0, permanent: tuple[type[Exception], ...] = (ValueError,), now: float | None = None) -> DataFrame:
    """``df`` with ``out`` = ``fn(text)``, asked once for each text and ``model`` in all runs that share the table ``cache``.

    Answers and failures are appended to the table by (model, SHA-256 of the text); each of ``rounds`` shares of the new texts is a job whose rows
    appear when it is committed, so a run that is killed loses the share in hand and no other. A failure is asked again when
    its next try is due: after ``retry_after_s``, doubled with each attempt; an error in ``permanent`` never is. Until then ``out`` is null.
    ``per_second`` bounds the calls of all tasks together, of which there are ``parallelism`` (the session's shuffle partitions if None).

    Null texts are not asked; equal texts are asked once; ``now`` (seconds since 1970) is the clock if it is not given.
    """
    spark = df.sparkSession
    clock = time.time() if now is None else now
    tasks = parallelism or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pause = tasks / per_second if per_second else 0.0
    key = F.sha2(F.col("_t").cast("binary"), 256)
    texts = df.select(F.col(text_col).cast("string").alias("_t")).where("_t is not null").distinct().withColumn("key", key)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = 0.0
        for batch in batches:
            rows = []
            for k, text, attempts in zip(*(batch.column(c).to_pylist() for c in ("key", "_t", "attempts")), strict=True):
                time.sleep(max(0.0, free - time.monotonic()))
                free = time.monotonic() + pause
                n, answer, error, due = (attempts or 0) + 1, None, None, None
                try:
                    answer = fn(text)
                    error = "no answer" if answer is None else None
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"[:500]
                    due = None if isinstance(e, permanent) else clock + retry_after_s * 2 ** (n - 1)
                rows.append({"model": model, "key": k, "answer": answer, "error": error, "attempts": n, "tried_at": clock, "next_try": due})
            yield pa.RecordBatch.from_pylist(rows, stored)

    text, number = pa.string(), pa.float64()
    stored = pa.schema([("model", text), ("key", text), ("answer", text), ("error", text), ("attempts", pa.int32()), ("tried_at", number), ("next_try", number)])
    for k in range(rounds):
        known = _known_answers(spark, cache, model)
        share = texts.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k).join(known, "key", "left")
        due = share.where("answer is null and (attempts is null or next_try <= {})".format(repr(clock)))
        due.select("key", "_t", "attempts").repartition(tasks, "key").mapInArrow(ask, ANSWERS).write.mode("append").parquet(cache)
    told = _known_answers(spark, cache, model).where("answer is not null").select(F.col("key").alias("_key"), F.col("answer").alias(out))
    return df.withColumn("_key", F.sha2(F.col(text_col).cast("string").cast("binary"), 256)).join(told, "_key", "left").select(*df.columns, out)
