"""Near-duplicate pictures by average hash."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueforge.functions.timecode import _col
from cueforge.operators.storage import stored

#: Close pairs of a folder that one task orders; folders with more go by rounds of joins.
FOLDER_PAIRS = 1_000_000


def average_hash(c: Column | str) -> Column:
    """16 hex digits: one bit for each of 64 grey values, set if at least the mean."""
    # One-element arrays bind a value that is used many times.
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    bits = lambda v: bound(total(v), lambda t: F.transform(v, lambda x: F.when(x * F.size(v) >= t, 1).otherwise(0)))
    digit = lambda b, i: F.lower(F.hex(F.get(b, i * 4) * 8 + F.get(b, i * 4 + 1) * 4 + F.get(b, i * 4 + 2) * 2 + F.get(b, i * 4 + 3)))
    text = lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: digit(b, i)), "")
    return bound(F.transform(_col(c), lambda x: x.cast("double")), lambda v: bound(bits(v), text))


def _keep_first(pairs: pd.DataFrame) -> pd.DataFrame:
    """Earlier file of each dropped one: a file goes if it is close to a kept one before it."""
    out, gone = [], set()
    for later, earlier in pairs.sort_values(["later", "earlier"]).groupby("later", sort=True)["earlier"].agg(list).items():
        kept = [e for e in earlier if e not in gone]
        if kept:
            gone.add(later)
            out.append((later, kept[0]))
    return pd.DataFrame({"folder": pairs["folder"].iloc[:1].repeat(len(out)).to_numpy(), "file_no": [x for x, _ in out], "of": [y for _, y in out]})


def _by_rounds(pairs: DataFrame) -> DataFrame:
    """The same rule for folders of any size: each round decides the files whose earlier neighbours are all decided."""
    state = pairs.select("folder", F.col("earlier").alias("file_no")).union(pairs.select("folder", F.col("later").alias("file_no"))).distinct()
    state = state.withColumn("s", F.lit("open")).withColumn("of", F.lit(None).cast("long"))
    while True:
        near = pairs.join(state.select("folder", F.col("file_no").alias("earlier"), "s"), ["folder", "earlier"])
        seen = near.groupBy("folder", F.col("later").alias("file_no")).agg(F.min(F.when(F.col("s") == "kept", F.col("earlier"))).alias("k"), F.count_if(F.col("s") == "open").alias("n"))
        j = state.join(seen, ["folder", "file_no"], "left")
        s = F.when(F.col("s") != "open", F.col("s")).when(F.col("k").isNotNull(), "gone").when(F.coalesce("n", F.lit(0)) == 0, "kept").otherwise("open")
        state = j.select("folder", "file_no", s.alias("s"), F.coalesce("of", F.when(s == "gone", F.col("k"))).alias("of"))
        state = stored(state, "frames")
        if not state.where("s = 'open'").head(1):
            return state.where("s = 'gone'").select("folder", "file_no", "of")


def near_duplicates(df: DataFrame, threshold: int = 5, folder: str = "folder", order: str = "file_no") -> DataFrame:
    """Rows (folder, file_no, status, duplicate_of): ``unique``, ``exact`` (md5 of an earlier file) or ``similar``.

    In file order a picture goes if at most ``threshold`` hex digits of its hash differ from a kept one's.
    Exact copies go first and are compared no further. The sixteen digits are cut in threshold + 2
    bands: close hashes share two of them, so candidates come from an equi-join on equal pairs of bands; equal hashes
    collapse before. The close pairs are stored once; folders of up to ``FOLDER_PAIRS`` of them are ordered by one task, others by rounds of joins.
    """
    base = df.select(F.col(folder).alias("folder"), F.col(order).cast("long").alias("file_no"), "md5", "ahash")
    w = Window.partitionBy("folder", "md5").orderBy("file_no")
    first = base.withColumn("_first", F.first("file_no").over(w))
    copies = first.where("file_no <> _first").select("folder", "file_no", "_first")
    left = first.where("file_no = _first").select("folder", "file_no", "ahash")
    same = left.withColumn("_head", F.min("file_no").over(Window.partitionBy("folder", "ahash")))
    heads = same.where("file_no = _head").select("folder", "file_no", "ahash")
    n = min(threshold + 2, 16)
    cuts = [round(16 * i / n) for i in range(n + 1)]
    band = [F.substring("ahash", cuts[i] + 1, cuts[i + 1] - cuts[i]) for i in range(n)]
    both = list(itertools.combinations(range(n), 2)) if threshold <= 14 else [(i, i) for i in range(n)]
    bands = F.array(*[F.struct(F.lit(i * n + j).alias("b"), F.concat(band[i], band[j]).alias("v")) for i, j in both])
    banded = heads.select("folder", "file_no", "ahash", F.explode(bands).alias("x")).select("folder", "file_no", "ahash", "x.b", "x.v")
    x = banded.select("folder", "b", "v", F.col("file_no").alias("earlier"), F.col("ahash").alias("h1"))
    y = banded.select("folder", "b", "v", F.col("file_no").alias("later"), F.col("ahash").alias("h2"))
    differ = F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(0), lambda a, i: a + F.when(F.substr("h1", i, F.lit(1)) != F.substr("h2", i, F.lit(1)), 1).otherwise(0))
    pairs = x.join(y, ["folder", "b", "v"]).where("earlier < later").where(differ <= threshold).select("folder", "earlier", "later").distinct()
    pairs = stored(pairs, "close-frames")
    large = pairs.groupBy("folder").count().where(F.col("count") > FOLDER_PAIRS).select("folder")
    small = pairs.join(large, "folder", "left_anti").groupBy("folder").applyInPandas(_keep_first, base.select("folder", "file_no", F.col("file_no").alias("of")).schema)
    gone = small.union(_by_rounds(pairs.join(large, "folder", "left_semi"))) if large.head(1) else small
    # A picture with the hash of an earlier one: similar to that if it is kept, else to what dropped that.
    told = same.join(gone.select("folder", F.col("file_no").alias("_head"), "of"), ["folder", "_head"], "left")
    status = F.when(F.col("of").isNotNull() | (F.col("file_no") != F.col("_head")), "similar").otherwise("unique")
    of = F.coalesce("of", F.when(F.col("file_no") != F.col("_head"), F.col("_head")))
    told = told.select("folder", "file_no", status.alias("status"), of.alias("duplicate_of"))
    # A copy of a picture that went is similar to what dropped that picture.
    of_first = copies.join(told.select("folder", F.col("file_no").alias("_first"), "duplicate_of"), ["folder", "_first"])
    kept = F.col("duplicate_of").isNull()
    exact = of_first.select("folder", "file_no", F.when(kept, "exact").otherwise("similar").alias("status"), F.coalesce("duplicate_of", "_first").alias("duplicate_of"))
    return told.unionByName(exact)
