"""Mixing sources to target weights: raking to margins, then sampling by calibrated probability."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueforge.llm.common import discard, materialize

#: Dimensions that are raked.
MARGINS = ("source", "language", "topic")
#: Cells (combinations of the margins) that are raked on the driver; more are raked by Spark.
DRIVER_CELLS = 50_000
UNSETTLED = "raking did not settle: the weights meet the last margin only"


def topic_of(text: Column) -> Column:
    """A coarse topic from the form of the whole text: figures, notes (short lines), essay or prose."""
    size = F.greatest(F.length(text), F.lit(1))
    digits = F.regexp_count(text, F.lit("[0-9]"))
    lines = F.regexp_count(text, F.lit("\\n")) + 1
    return F.when(digits * 50 > size, "figures").when(size < lines * 60, "notes").when(size > 4000, "essay").otherwise("prose")


def measured(docs: DataFrame) -> DataFrame:
    """Rows (row, doc_id, source, language, topic, tokens): the whole row beside its margins; tokens are words; null margins are 'unknown', null texts empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), known("source").alias("source"), known("lang").alias("language"), topic_of(text).alias("topic"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("tokens"))


def flattened(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares (value, share) of a margin: its token shares raised to ``power`` and scaled to one."""
    m = cells.where("tokens > 0").groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("t")).select("value", F.pow("t", F.lit(power)).alias("t"))
    whole = m.agg(F.sum("t")).first()[0] or 1.0
    return m.select("value", (F.col("t") / F.lit(float(whole))).alias("share"))


def _rake_here(rows: list, targets: dict[str, dict], rounds: int, tolerance: float) -> list[float]:
    weight = [1.0] * len(rows)
    total = float(sum(r["tokens"] for r in rows)) or 1.0
    for _ in range(rounds):
        worst = 0.0
        for margin in MARGINS:
            have: dict = {}
            for r, w in zip(rows, weight, strict=True):
                have[r[margin]] = have.get(r[margin], 0.0) + w * r["tokens"]
            factor = {v: targets[margin].get(v, 0.0) * total / h if h > 0 else 1.0 for v, h in have.items()}
            worst = max([worst, *(abs(f - 1) for v, f in factor.items() if have[v] > 0)])
            weight = [w * factor[r[margin]] for r, w in zip(rows, weight, strict=True)]
        if worst < tolerance:
            break
    else:
        warnings.warn(UNSETTLED, stacklevel=3)
    return weight


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """``cells`` (margins, tokens) with ``weight``, so that weighted tokens meet the target share of every margin.

    Iterative proportional fitting: each margin in turn scales its values to their targets, until
    no factor differs from one by ``tolerance``; if ``rounds`` don't suffice there is a warning. Margin values without a target get weight 0. A table of up to
    ``DRIVER_CELLS`` cells is fitted on the driver, a larger one by joins, one table a round.
    """
    spark = cells.sparkSession
    if cells.count() <= DRIVER_CELLS:
        rows = sorted(cells.collect(), key=lambda r: tuple(r[m] for m in MARGINS))
        wanted = {m: {r["value"]: r["share"] for r in targets[m].collect()} for m in MARGINS}
        weight = _rake_here(rows, wanted, rounds, tolerance)
        out = [(*(r[m] for m in MARGINS), r["tokens"], w) for r, w in zip(rows, weight, strict=True)]
        return spark.createDataFrame(out, "source string, language string, topic string, tokens long, weight double")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    fitted, written = cells.select(*MARGINS, "tokens", F.lit(1.0).alias("weight")), []
    for _ in range(rounds):
        worst = 0.0
        for margin in MARGINS:
            have = fitted.groupBy(margin).agg(F.sum(F.col("weight") * F.col("tokens")).alias("have"))
            factor = have.join(targets[margin].withColumnRenamed("value", margin), margin, "left").select(margin, F.when(F.col("have") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("have")).otherwise(1.0).alias("factor"))
            factor = materialize(factor, "factor")
            worst = max(worst, factor.agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            scaled = materialize(fitted.join(factor, margin).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"), "raked")
            discard(factor, *written)
            fitted, written = scaled, [scaled]
        if worst < tolerance:
            break
    else:
        warnings.warn(UNSETTLED, stacklevel=2)
    return fitted.select(*MARGINS, "tokens", "weight")


def weighted(docs: DataFrame, budget: float = 0.5, power: float = 0.5, targets: dict[str, DataFrame] | None = None, salt: str = "mix") -> DataFrame:
    """Rows (row, doc_id, source, language, topic, tokens, weight, probability, sampled), one per document.

    Token weights are raked to the target shares of source, language and topic (by default the
    corpus's own shares, flattened by ``power``). A document is drawn with probability
    rate * weight, at most 1; the rate is set so that the expected tokens are ``budget`` of the corpus, as
    far as probabilities of at most 1 allow. The draw is a hash of doc_id, so it is the same in every run; repeated ids are
    drawn together. Null ids, margins and texts are valid; a document without words has its cell's probability, and
    in a cell without any words probability 0.
    """
    marks = measured(docs)
    cells = materialize(marks.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    targets = targets or {m: flattened(cells, m, power) for m in MARGINS}
    fitted = materialize(rake(cells, targets), "weights")
    want = (fitted.agg(F.sum("tokens")).first()[0] or 0) * budget
    rate = budget
    for _ in range(60):  # the rate grows until the capped probabilities give the budget
        full, free = fitted.agg(F.sum(F.when(F.col("weight") * rate >= 1, F.col("tokens"))), F.sum(F.when(F.col("weight") * rate < 1, F.col("tokens") * F.col("weight")))).first()
        new = (want - (full or 0)) / free if free else rate
        if abs(new - rate) <= 1e-12 * max(rate, 1e-12):
            break
        rate = max(new, rate)
    odds = fitted.select(*(F.col(m) for m in MARGINS), F.when(F.col("tokens") > 0, F.col("weight")).otherwise(0.0).alias("weight"))
    if cells.count() <= DRIVER_CELLS:
        odds = F.broadcast(odds)
    out = marks.join(odds, list(MARGINS)).withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(rate)))
    draw = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(salt)), 11) / F.lit(float(1 << 53))
    return out.select("row", "doc_id", *MARGINS, "tokens", "weight", "probability", (draw < F.col("probability")).alias("sampled"))
