"""Near-duplicates by Jaccard similarity of shingle sets: SimHash values link first, prefixes make the candidates beyond, sketches prune them, whole sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueforge.llm.common import discard, drawn, hash_words, materialize, slices, split_words, window_hashes
from cueforge.llm.graph import connected_components
from cueforge.llm.simhash import fingerprints, link_fingerprints

#: Documents from which common shingles are learned, and how many shingles are kept. Both only order the shingles: any order gives the same result.
SAMPLE_DOCS = 20_000
COMMON = 200_000
#: Ids of documents that are broadcast (8 MB); the texts of more are shuffled.
BROADCAST_IDS = 1_000_000
#: Values of a key that are paired at once; larger keys first meet one of their values in some rounds.
SMALL = 8
SKETCH = ("s0", "s1", "s2", "s3")
WIDE = 4096
STARS = 3
ROUNDS = 1


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; A-Z are lower-cased.

    A text with fewer words than a shingle has one shingle, an empty or null text none.
    """
    off, words = split_words(texts)
    h = hash_words(pc.ascii_lower(words))
    whole = window_hashes(h, shingle)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        w = whole[a : b - shingle + 1] if b - a >= shingle else window_hashes(h[a:b], b - a) if b > a else h[:0]
        out.append(np.unique(w))
    return out


def _node(s: np.ndarray) -> int:
    n = xxhash.xxh64_intdigest(s.tobytes())
    return n - (1 << 64) if n >> 63 else n


def _sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the shingles that fall on each bit: two sets' sketches differ in no more bits than the sets in shingles."""
    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _near(a: dict[str, str], b: dict[str, str], share: float) -> Column:
    """What sizes and sketches of two sets of similarity ``share`` satisfy."""
    differ = sum((F.bit_count(F.col(a[s]).bitwiseXOR(F.col(b[s]))) for s in SKETCH), F.lit(0))
    sized = F.least(a["size"], b["size"]) >= F.greatest(a["size"], b["size"]) * F.lit(share) - 1e-9
    return sized & (differ <= (F.col(a["size"]) + F.col(b["size"])) * F.lit((1 - share) / (1 + share)) + 1e-9)


def _least(size: int, share: float) -> int:
    """Fewest shingles that a set of ``size`` shares with a set of similarity ``share``."""
    return max(1, math.ceil(share * size - 1e-9))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample hold, with their counts."""
    sample = drawn(docs, SAMPLE_DOCS, docs.count(), F.col("doc_id"), "shingles")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(part.column("text"), shingle)).view(np.int64))], names=["s"])

    top = sample.mapInArrow(rows, "s long").groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(COMMON).collect()
    s, c = np.array([r["s"] for r in top], np.int64).view(np.uint64), np.array([r["count"] for r in top], np.int64)
    order = np.argsort(s)
    return s[order], c[order]


def _prefixes(docs: DataFrame, shingle: int, share: float) -> DataFrame:
    """Rows (doc_id, node, size, sketch columns, keys): the hash of a document's set, its size, sketch and rarest shingles.

    Two sets of similarity ``share`` agree in at least ceil(share * size) shingles of each, so in
    one fixed order of all shingles the first size - ceil(share * size) + 1 of both have one in common.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = sent.value
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), shingle)
                keys = []
                for s in sets:
                    n = len(s) - _least(len(s), share) + 1 if len(s) else 0
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        s = s[np.lexsort((s, np.where(common[at] == s, counts[at], 0)))]
                    keys.append(s[:n].view(np.int64))
                off = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                bits = np.stack([_sketch(s, 64 * len(SKETCH)) for s in sets])
                wide = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (WIDE // 64)), pa.array(np.concatenate([_sketch(s, WIDE) for s in sets])))
                cols = [part.column("doc_id"), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(bits[:, i]) for i in range(len(SKETCH)))]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(keys))), wide], names=["doc_id", "node", "size", *SKETCH, "keys", "wide"])

    return docs.mapInArrow(rows, f"doc_id long, node long, size long, {' long, '.join(SKETCH)} long, keys array<long>, wide array<long>")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, share: float) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets have a similarity of at least ``share``."""
    # Wide sketches of the nodes first: what differs in too many bits needs no sets.
    own = lambda k: reps.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("wide").alias(f"wide_{k}"))
    differ = F.expr("aggregate(zip_with(wide_a, wide_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    pairs = pairs.join(own("a"), "a").join(own("b"), "b").where(differ <= (F.col("size_a") + F.col("size_b")) * F.lit((1 - share) / (1 + share)) + 1e-9)
    pairs = materialize(pairs.select("a", "b"), "alike")
    met = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(reps.join(met, "node").select("rep").distinct().withColumnRenamed("rep", "doc_id"), "wanted")
    few = wanted.count() <= BROADCAST_IDS

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = shingle_sets(part.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in own], pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s) for s in own]))).astype(np.int32)), pa.array(np.concatenate(own).view(np.int64)))], names=["node", "s"])

    held = materialize(docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi").select("text").mapInArrow(sets, "node long, s array<long>"), "sets")
    one = pairs.join(held.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
    both = one.join(held.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    near = materialize(both.where(same >= F.lit(share) * (F.size("x") + F.size("y") - same) - F.lit(1e-9)).select("a", "b").distinct(), "near")
    discard(wanted, held, pairs)
    return near


def _by_fingerprint(docs: DataFrame, reps: DataFrame, shingle: int, share: float) -> DataFrame:
    """Links (a, b) of nodes by pigeonring on the SimHash values of their shingles, within two bits, that whole sets confirm.

    Nodes of one value meet the least of them, and the least nodes of two linked values meet: a few rows a node.
    """
    own = fingerprints(docs, shingle).join(reps.select(F.col("rep").alias("doc_id"), "node"), "doc_id").select("fp", "node").distinct()
    own = materialize(own, "fingerprints")
    first = materialize(own.groupBy("fp").agg(F.min("node").alias("first")), "first-nodes")
    same = own.join(first, "fp").select(F.col("node").alias("x"), F.col("first").alias("y"))
    of = lambda k, n: first.select(F.col("fp").alias(k), F.col("first").alias(n))
    other = link_fingerprints(first.select("fp")).join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    pairs = same.union(other).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return _verified(materialize(pairs, "marked"), reps, docs, shingle, share)


def _candidates(a: DataFrame, b: DataFrame, share: float) -> DataFrame:
    """Distinct pairs of nodes of one key whose components differ and whose sizes and sketches allow the similarity."""
    names = ("node", "size", "comp", *SKETCH)
    left, right = (x.select("key", *[F.col(c).alias(f"{c}_{k}") for c in names]) for k, x in (("a", a), ("b", b)))
    near = _near({c: f"{c}_a" for c in names}, {c: f"{c}_b" for c in names}, share)
    met = left.join(right, "key").where("node_a <> node_b and comp_a <> comp_b").where(near)
    return materialize(met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "candidates")


def _stars(large: DataFrame, share: float) -> DataFrame:
    """Distinct pairs: in each of some rounds a node meets one node of one of its large keys, that of the least hash.

    Near copies have mostly the same keys, so the least is mostly the same one: a large group of them is joined at a
    row for each node and round, whatever the number of its keys.
    """
    found = None
    for k in range(STARS):
        names = ("node", "size", *SKETCH)
        own = large.groupBy(*names).agg(F.min(F.struct(F.xxhash64("key", F.lit(k)).alias("h"), "key")).alias("p")).select(*names, "p.key")
        own = materialize(own, "least-keys")
        first = own.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), *names)).alias("f")).select("key", *[F.col(f"f.{c}").alias(f"to_{c}") for c in names])
        near = _near({c: c for c in names}, {c: f"to_{c}" for c in names}, share)
        met = own.join(first, "key").where("node <> to_node").where(near).select(F.least("node", "to_node").alias("a"), F.greatest("node", "to_node").alias("b"))
        found = met if found is None else found.union(met)
    return materialize(found.distinct(), "stars")


def groups(docs: DataFrame, shingle: int = 5, share: float = 0.8) -> DataFrame:
    """Rows (doc_id, component_id) of the documents with an id.

    Documents link when the Jaccard similarity of their sets of ``shingle``-word shingles is at
    least ``share``; component_id is the smallest doc_id reachable. No linked pair is missed: every
    pair with a common key is compared by whole sets, unless links already join it. Equal sets
    collapse first; then SimHash values within two bits, found by pigeonring, link what whole sets confirm, and prefixes only
    pair what these links leave apart. Pairs whose sketches differ in too many bits are not made. Of keys of over ``SMALL`` values
    each node first meets one value of one key, three times with another one, then the nodes of each key that still
    holds several components meet one of them, another one in each key; so a large group of near copies is joined in
    a few rows for each node and key. Only what is still apart is paired. 64 hash bits stand for a shingle's words.
    Documents without words are equal.
    """
    docs = _texts(docs)
    whole = materialize(_prefixes(docs, shingle, share), "prefixes")
    marks = materialize(whole.select("doc_id", "node"), "marks")
    nodes = whole.groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("size", *SKETCH, "keys", "wide")])
    nodes = materialize(nodes, "nodes")
    discard(whole)
    reps = nodes.select("node", "rep", "size", "wide")
    marked = _by_fingerprint(docs, reps, shingle, share)
    joined = materialize(connected_components(marked), "joined")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    # Most keys are held once; only the others' rows get sizes and sketches.
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes")
    met = materialize(keyed.join(sizes, "key").select("key", "node", (F.col("n") > SMALL).alias("large")), "shared-keys")
    traits = nodes.select("node", "size", *SKETCH).join(joined.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    met = materialize(met.join(traits, "node").select("key", "node", "size", *SKETCH, "comp", "large"), "met")
    small, open_ = met.where("not large"), met.where("large")
    edges = _verified(_candidates(small, small.where("true"), share), reps, docs, shingle, share)
    edges = edges.union(_verified(_stars(open_, share), reps, docs, shingle, share)).union(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
    parts = materialize(connected_components(edges), "parts")
    for k in range(ROUNDS + 1):
        placed = open_.drop("comp").join(parts.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        placed = materialize(placed, "placed")
        apart = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct(F.xxhash64("node", "key", F.lit(k)).alias("h"), "node", "size", "comp", *SKETCH)).alias("first")).where("low < high")
        apart = materialize(apart.select("key", "first.node", "first.size", "first.comp", *[f"first.{s}" for s in SKETCH]), "apart")
        if apart.isEmpty():
            break
        open_ = materialize(placed.join(apart.select("key"), "key", "left_semi"), "open")
        if k < ROUNDS:
            pairs = _candidates(open_, apart, share)
        else:  # of two nodes in different components one at least isn't in that of the key's chosen node
            rest = open_.join(apart.select("key", F.col("comp").alias("chosen")), "key").where("comp <> chosen").drop("chosen")
            pairs = _candidates(rest, open_, share)
        near = _verified(pairs, reps, docs, shingle, share)
        if not near.isEmpty():
            parts = materialize(connected_components(near.union(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))), "parts")
    found = materialize(reps.join(parts, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")), "found")
    least = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    placed = materialize(found.join(least, "component").select("node", "component_id"), "placed")
    return marks.select("doc_id", "node").join(placed, "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame, shingle: int = 5, share: float = 0.8) -> DataFrame:
    """``docs`` with the smallest doc_id of each group of near-duplicates; rows with a null doc_id stay."""
    drop = groups(docs, shingle, share).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
