"""Checking base files before they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.functions.text import trim_all


def validate_base(lines: DataFrame, track: str = "track_id", line_no: str = "line_no", value: str = "value", head: int = 5) -> DataFrame:
    """Rows (track_id, ok, reason, bad_line): the first failing rule on the first ``head`` physical lines.

    Lines need six columns, times that end in ``s``, and glosses that are empty, ``N/A`` or a JSON
    list of strings with a reading in parentheses before the colon.
    """
    p = F.split(value, "\t")
    pairs = trim_all(F.get(p, F.lit(4)))
    listed = F.from_json(pairs, "array<string>")
    good = F.coalesce(F.forall(listed, lambda x: (F.instr(x, ": ") > 0) & F.substring_index(x, ": ", 1).rlike(r"\(.*\)")), F.lit(False))
    reason = (
        F.when(F.size(p) < 6, "columns")
        .when(~trim_all(F.get(p, F.lit(1))).endswith("s"), "begin")
        .when(~trim_all(F.get(p, F.lit(2))).endswith("s"), "end")
        .when((pairs != "") & (pairs != "N/A") & (listed.isNull() | ~pairs.startswith("[")), "pairs_json")
        .when((pairs != "") & (pairs != "N/A") & ~good, "pairs_shape")
    )
    ruled = lines.where(F.col(line_no) <= head).select(F.col(track).alias("track_id"), F.col(line_no).alias("_n"), reason.alias("_r"))
    bad = F.min(F.when(F.col("_r").isNotNull(), F.struct("_n", "_r")))
    return ruled.groupBy("track_id").agg(bad.alias("b")).select("track_id", F.col("b").isNull().alias("ok"), F.col("b._r").alias("reason"), F.col("b._n").alias("bad_line"))
