"""Running values along a track that may be larger than a task: two levels of scan instead of one window.

A track is cut into segments by its order column. Each segment is one window; its sums or edge rows, one row a segment, are carried along the track,
and join the rows again by (track, segment), by which these are partitioned already: the rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column in a segment, for places that follow each other.
SPAN = 1 << 16
_TRACK, _SEGMENT = "_scan_track", "_scan_segment"
_KEYS = [_TRACK, _SEGMENT]


def segmented(df: DataFrame, track: str, order: list[str], span: int) -> DataFrame:
    """``df`` with its track and segment as keys that are never null; a null place is before all others."""
    key = F.coalesce(F.concat(F.lit("="), F.col(track).cast("string")), F.lit(""))
    return df.withColumns({_TRACK: key, _SEGMENT: F.coalesce(F.expr(f"cast(`{order[0]}` as bigint) div {span}"), F.lit(-(1 << 62)))})


def inside(order: list[str]):
    """The window of a segment."""
    return Window.partitionBy(*_KEYS).orderBy(*order)


def along():
    """The window of a track's segments."""
    return Window.partitionBy(_TRACK).orderBy(_SEGMENT)


def carried(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Segmented ``rows`` with the columns of ``parts``, which has one row a segment; the keys go."""
    return rows.join(parts, _KEYS, "left").drop(*_KEYS)


def running(df: DataFrame, track: str, order: list[str], sums: dict[str, Column], inclusive: bool = True, span: int = SPAN) -> DataFrame:
    """``df`` with running sums of whole numbers along each track, this row included or not; a null counts 0.

    ``order`` has columns that tell any two rows of a track apart; the first is a whole number, of which ``span`` values are a segment.
    """
    x = segmented(df, track, order, span).withColumns({f"_v_{c}": F.coalesce(v.cast("long"), F.lit(0).cast("long")) for c, v in sums.items()})
    parts = x.groupBy(*_KEYS).agg(*[F.sum(f"_v_{c}").alias(f"_s_{c}") for c in sums])
    before = along().rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*_KEYS, *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    own = inside(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    here = x.withColumns({c: F.coalesce(F.sum(f"_v_{c}").over(own), F.lit(0)) for c in sums})
    out = carried(here, parts).withColumns({c: F.col(c) + F.col(f"_b_{c}") for c in sums})
    return out.drop(*[f"_v_{c}" for c in sums], *[f"_b_{c}" for c in sums])


def ranked(df: DataFrame, track: str, order: list[str], out: str, span: int = SPAN) -> DataFrame:
    """``df`` with the place of each row in its track, from 1."""
    return running(df, track, order, {out: F.lit(1)}, span=span).withColumn(out, F.col(out).cast("int"))


def next_value(df: DataFrame, track: str, order: list[str], value: str, out: str, span: int = SPAN) -> DataFrame:
    """``df`` with ``out``: ``value`` of the track's next row, null at its end. Where a segment ends, it is that of the next one's first row."""
    x = segmented(df, track, order, span)
    first = x.groupBy(*_KEYS).agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_first"))
    parts = first.select(*_KEYS, F.lead("_first").over(along()).alias("_scan_after"))
    here = x.withColumn("_scan_next", F.lead(F.struct(F.col(value).alias("v"))).over(inside(order)))
    return carried(here, parts).withColumn(out, F.coalesce("_scan_next", "_scan_after")["v"]).drop("_scan_next", "_scan_after")


def islands(df: DataFrame, track: str, order: list[str], value: str, out: str, span: int = SPAN) -> DataFrame:
    """``df`` with ``out``: the number, from 1, of the run of rows with equal ``value`` (nulls are equal) that a row is in."""
    held = F.struct(F.col(value).alias("v"))
    w = inside(order)
    other = F.when(F.lag(held).over(w).isNull() | F.lag(held).over(w).eqNullSafe(held), 0).otherwise(1)
    x = segmented(df, track, order, span).withColumn("_new", other)
    edge = F.struct(*order)
    parts = x.groupBy(*_KEYS).agg(F.sum("_new").alias("_n"), F.min_by(held, edge).alias("_first"), F.max_by(held, edge).alias("_last"))
    begun = F.when(F.lag("_last").over(along()).isNull() | ~F.lag("_last").over(along()).eqNullSafe(F.col("_first")), 1).otherwise(0)
    parts = parts.withColumn("_begun", begun)
    until = along().rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select(*_KEYS, (F.sum(F.col("_begun") + F.col("_n")).over(until) - F.col("_n")).alias("_before"))
    here = x.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return carried(here, parts).withColumn(out, F.col(out) + F.col("_before")).drop("_new", "_before")


def nearest(rows: DataFrame, marks: DataFrame, track: str, at: str, order: list[str], out: str, ahead: bool = False, span: int = SPAN) -> DataFrame:
    """``rows`` with ``out``: the struct of the track's last mark at or before their ``at``, or with ``ahead`` of the first at or after it; null without one.

    Both tables have ``track`` and ``at``, a whole number of which ``span`` values are a segment; of marks at one place the last by ``order`` counts, or with
    ``ahead`` the first. Each row and each mark is shuffled once. Null tracks and places have no mark.
    """
    told = F.struct(*marks.columns)
    key = F.when(F.col(at).isNotNull(), F.struct(F.col(at).cast("long").alias("at"), *order))
    both = rows.select(F.col(track).cast("string").alias("_t"), F.col(at).cast("long").alias("_at"), F.struct(*rows.columns).alias("_row")).unionByName(
        marks.where(F.col(at).isNotNull() & F.col(track).isNotNull()).select(F.col(track).cast("string").alias("_t"), F.col(at).cast("long").alias("_at"), key.alias("_order"), told.alias("_mark")),
        allowMissingColumns=True,
    )
    x = segmented(both, "_t", ["_at"], span)
    turn = F.desc if ahead else F.asc
    # At one place marks come before the rows that they count for.
    w = Window.partitionBy(*_KEYS).orderBy(turn("_at"), F.col("_mark").isNull(), turn("_order")).rowsBetween(Window.unboundedPreceding, 0)
    edge = F.min_by("_mark", "_order") if ahead else F.max_by("_mark", "_order")
    before = Window.partitionBy(_TRACK).orderBy(turn(_SEGMENT)).rowsBetween(Window.unboundedPreceding, -1)
    parts = x.groupBy(*_KEYS).agg(edge.alias("_edge")).select(*_KEYS, F.last("_edge", ignorenulls=True).over(before).alias("_carried"))
    here = x.withColumn("_here", F.last("_mark", ignorenulls=True).over(w)).where("_row is not null")
    found = F.when(F.col("_at").isNotNull(), F.coalesce("_here", "_carried"))
    return carried(here, parts).select("_row.*", found.alias(out))


def records(df: DataFrame, track: str, order: list[str], value: str, span: int = SPAN) -> DataFrame:
    """The rows whose ``value`` is greater than that of every earlier row of their track."""
    x = segmented(df.where(F.col(value).isNotNull()), track, order, span)
    until = along().rowsBetween(Window.unboundedPreceding, -1)
    parts = x.groupBy(*_KEYS).agg(F.max(value).alias("_most")).select(*_KEYS, F.max("_most").over(until).alias("_before"))
    here = x.withColumn("_here", F.max(value).over(inside(order).rowsBetween(Window.unboundedPreceding, -1)))
    most = F.greatest("_here", "_before")
    return carried(here, parts).where(most.isNull() | (F.col(value) > most)).select(*df.columns)
