"""SimHash near-duplicates: fingerprints linked by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueforge.llm.common import materialize, slices
from cueforge.llm.graph import connected_components

BITS = 64
SEGMENTS = 16


def _fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()][:n]
    ends = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Rows (doc_id, fp long): SimHash of the XXH64 values of word shingles, repeats included.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a text with fewer
    words than a shingle has one shingle, an empty or null text the fingerprint zero.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = pa.array([_fingerprint(t, shingle) for t in part.column("text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), fp], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, fp long")


def _ring(fp: Column, at: Column) -> Column:
    """``fp`` turned left so that segment ``at`` comes first."""
    by = at * (BITS // SEGMENTS)
    turned = F.call_function("shiftleft", fp, by).bitwiseOR(F.call_function("shiftrightunsigned", fp, (F.lit(BITS) - by) % BITS))
    return F.when(at == 0, fp).otherwise(turned)


def link_fingerprints(distinct: DataFrame, threshold: int = 2, bucket: int = 64) -> DataFrame:
    """Edges (a, b) between the values ``fp`` of ``distinct`` whose links join all values within ``threshold`` bits.

    Pigeonring: the 64 bits are 16 segments on a ring. Two values within ``threshold`` bits have a
    start from which every chain of l segments differs in at most l * threshold / 16 bits. The
    longest chain whose budget is below one bit is the join key; the longer chains' budgets prune
    the pairs, then the whole distance decides. Buckets of over ``bucket`` values are not paired:
    their values meet at each value one bit away (for a threshold of 2, two values are in reach
    exactly if they share such a value), 65 rows for each and no pairs, so nothing is lost.
    """
    if threshold != 2:
        raise ValueError("the exact path for large buckets is written for a threshold of 2")
    exact = (SEGMENTS - 1) // threshold  # chains of so many segments have a budget below 1
    width = BITS // SEGMENTS
    seg = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("at"))
    keyed = seg.select("fp", F.xxhash64("at", F.call_function("shiftrightunsigned", _ring(F.col("fp"), F.col("at")), F.lit(BITS - exact * width))).alias("key"), "at")
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = materialize(keyed.join(sizes, "key").select("key", "at", "fp", (F.col("n") > bucket).alias("large")), "met")
    a, b = met.where("not large").select("key", "at", F.col("fp").alias("a")), met.where("not large").select("key", F.col("fp").alias("b"))
    diff = _ring(F.col("a").bitwiseXOR(F.col("b")), F.col("at"))
    near = F.bit_count(F.call_function("shiftrightunsigned", diff, F.lit(width))) <= (SEGMENTS - 1) * threshold // SEGMENTS
    pairs = a.join(b, "key").where("a < b").where(near).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold).select("a", "b").distinct()
    large = met.where("large").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(BITS)])
    between = materialize(large.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")), "between")
    centre = materialize(between.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("mid", "b"), "centre")
    stars = between.join(centre, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, shingle: int = 3, threshold: int = 2) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per document.

    Documents link when their fingerprints differ in at most ``threshold`` bits; component_id is
    the smallest doc_id reachable. Equal fingerprints collapse to one value first, so groups of
    exact copies cost one row. Documents without words share fingerprint zero and are linked by
    it. A null doc_id keeps its row and gets the component of its fingerprint (null if no
    document with an id is reachable). An empty table gives an empty result.
    """
    marks = materialize(fingerprints(docs, shingle), "marks")
    reps = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    parts = connected_components(link_fingerprints(reps, threshold))
    found = reps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = materialize(found.groupBy("component").agg(F.min("rep").alias("component_id")), "least-id")
    placed = materialize(found.join(least, "component").select("fp", "component_id"), "placed")
    return marks.join(placed, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, threshold: int = 2) -> DataFrame:
    """``docs`` with the smallest doc_id of each group of near-duplicates; rows with a null doc_id stay."""
    groups = near_duplicates(docs, shingle, threshold)
    drop = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
