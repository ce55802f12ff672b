"""Benchmark decontamination: spaced-seed hits, then overlaps that tolerate substitutions.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueforge.llm.common import materialize

#: Fixed masks over token positions; 0 positions are ignored by the hash. Whichever tokens are substituted, as many as
#: an overlap allows, one mask shows none of them at some place: MASKS for items of 8 tokens or more, SHORT_MASKS for less.
MASKS = ("111011", "11001011", "11111")
SHORT_MASKS = ("1111", "11011")
#: Items of fewer tokens than LEAST must occur as they are; MASKS serve items of LONG tokens or more.
LEAST, LONG = 6, 8
#: Benchmark items are compared in parts of so many tokens, half overlapping.
PART = 64
#: Seeds up to this count are broadcast (about 40 MB); more are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000


def _tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(tokens: str, at: str, masks: dict[str, str], where: str = "true") -> list[str]:
    """SQL of one hash for each mask (id: mask), of the tokens that it shows from place ``at``; null past the end or unless ``where``."""
    shown = lambda m: ", ".join(f"get({tokens}, {at} + {i})" for i, c in enumerate(m) if c == "1")
    return [f"if({at} + {len(m)} <= size({tokens}) and {where}, xxhash64('{k}', {shown(m)}), null)" for k, m in masks.items()]


def _starts(tokens: str, span: int) -> Column:
    # The outer form: for the inner one a filter on the tokens is inferred, which computes them twice.
    return F.expr(f"explode_outer(if(size({tokens}) >= {span}, sequence(0, size({tokens}) - {span}), cast(array() as array<int>)))")


def benchmark_parts(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (item_id, part, want): each item's tokens in half overlapping parts."""
    t = benchmark.select(F.col(item_id).cast("long").alias("item_id"), _tokens(F.col(text)).alias("t")).where("size(t) > 0")
    cut = t.select("item_id", "t", F.expr(f"explode(sequence(0, greatest(size(t) - {PART // 2} - 1, 0) div {PART // 2}))").alias("part"))
    return cut.select("item_id", "part", F.expr(f"slice(t, part * {PART // 2} + 1, {PART})").alias("want")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 16, share: float = 0.8) -> DataFrame:
    """Rows (doc_id, item_id, matched, compared, similarity) for each document and item that overlap.

    A document holds an item if, along one alignment of the two, some ``window`` consecutive tokens
    of the item (all, if it has fewer) agree in at least ``share`` of the places; the best alignment
    is told: matched is the number of equal tokens of compared ones over the part. Alignments come
    from seeds that agree under one of the masks; with the given window and share no overlap is
    missed, so up to one token in five may be substituted at any place. Items under 6 tokens are held where
    all their tokens follow each other. Documents with a null id or without tokens have no row, nor have items without
    tokens. Repeated rows and ties give one row for each document and item.
    """
    parts = materialize(benchmark_parts(benchmark), "bench-parts")
    sizes = {r["n"] for r in parts.select(F.size("want").alias("n")).distinct().collect()}
    # Only the masks of the items that are there.
    long = {f"long{k}": m for k, m in enumerate(MASKS)} if any(n >= LONG for n in sizes) else {}
    short = {f"short{k}": m for k, m in enumerate(SHORT_MASKS)} if any(LEAST <= n < LONG for n in sizes) else {}
    whole = {f"whole{n}": "1" * n for n in sorted(sizes) if n < LEAST}
    masks = long | short | whole
    if not masks:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, matched int, compared int, similarity double")
    span = min(map(len, masks.values()))
    own = _seeds("want", "at", long, f"size(want) >= {LONG}") + _seeds("want", "at", short, f"size(want) between {LEAST} and {LONG - 1}")
    own += [s for k, m in whole.items() for s in _seeds("want", "at", {k: m}, f"at = 0 and size(want) = {len(m)}")]
    bench = parts.select("item_id", "part", "want", _starts("want", span).alias("at")).where("at is not null")
    bench = bench.select("item_id", "part", F.col("at").alias("q"), F.size("want").alias("n"), F.explode(F.expr(f"array({', '.join(own)})")).alias("seed")).where("seed is not null")
    bench = materialize(bench, "bench-seeds")
    tokens = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _tokens(F.col("text")).alias("t"))
    t = tokens.select("doc_id", "t", _starts("t", span).alias("p")).where("p is not null")
    seeded = t.withColumn("seed", F.explode(F.expr(f"array({', '.join(_seeds('t', 'p', masks))})")))
    # The aligned tokens travel with a hit: at most PART of them, whatever the document's length.
    got = F.expr("slice(t, greatest(shift, 0) + 1, n + least(shift, 0))").alias("got")
    shift = (F.col("p") - F.col("q")).alias("shift")
    if bench.count() <= BROADCAST_SEEDS:
        hits = seeded.join(F.broadcast(bench), "seed").select("doc_id", "item_id", "part", shift, "n", "t").select("doc_id", "item_id", "part", "shift", got)
    else:
        # Only places are shuffled; the tokens join the hits.
        met = seeded.select("doc_id", "p", "seed").where("seed is not null").join(bench, "seed").select("doc_id", "item_id", "part", shift, "n").distinct()
        hits = met.join(tokens, "doc_id").select("doc_id", "item_id", "part", "shift", got)
    lines = hits.distinct()
    if parts.count() <= BROADCAST_SEEDS // PART:
        parts = F.broadcast(parts)
    both = lines.join(parts, ["item_id", "part"])
    equal = "transform(sequence(0, size(want) - 1), i -> if(i + least(shift, 0) >= 0 and get(got, i + least(shift, 0)) <=> want[i], 1, 0))"
    both = both.select("doc_id", "item_id", F.expr(equal).alias("eq"), F.least(F.lit(window), F.size("want")).alias("w"))
    best = "array_max(transform(sequence(0, size(eq) - w), i -> aggregate(slice(eq, i + 1, w), 0, (s, x) -> s + x)))"
    both = both.withColumn("best", F.expr(best)).where(F.col("best") >= F.col("w") * F.lit(share))
    told = F.expr("named_struct('matched', aggregate(eq, 0, (s, x) -> s + x), 'compared', size(eq), 'similarity', best / w)")
    return both.select("doc_id", "item_id", told.alias("m")).groupBy("doc_id", "item_id").agg(F.max("m").alias("m")).select("doc_id", "item_id", "m.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 16, share: float = 0.8, least: int = LEAST) -> DataFrame:
    """``docs`` without those that hold a benchmark item of ``least`` tokens or more; rows with a null doc_id stay.

    A few words in common are no evidence of a leak: for shorter items see ``overlaps``, or give a smaller ``least``.
    """
    long = benchmark.where(F.size(_tokens(F.col("text"))) >= least)
    held = overlaps(docs, long, window, share).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(*docs.columns)
