"""Exact top-k search by inner product with a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueforge.llm.common import materialize

#: Queries of a block, and rows of the table for which a task holds bounds at once.
QUERY_BLOCK = 1024
ROW_BLOCK = 2048
#: Rows of a group that meets all blocks of queries (smaller ones, up to 256, while there are fewer rows).
GROUP_ROWS = 1 << 20
#: Blocks of queries that a task keeps open.
OPEN_BLOCKS = 4
#: Bits of a cell number in each dimension.
CELL_BITS = 6


def _vectors(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    x = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    x = x.where("vec_id is not null and x is not null and size(x) > 0").where("not exists(x, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    return x.select("vec_id", F.expr("transform(x, c -> cast(floor(256 * c) as bigint))").alias("v"))


@dataclass
class VectorFile:
    """Table (vec_id, cells, v) and, by length of a vector, each dimension's lowest value and cell width.

    ``wide`` has the lengths whose scores may pass 2^52: their cells are not used, and scores are whole numbers of any size.
    """

    table: DataFrame
    ranges: dict[int, tuple[np.ndarray, np.ndarray]]
    wide: set[int] = field(default_factory=set)


def build_file(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> VectorFile:
    """Each exact vector beside its cell numbers, as a table in the shared folder; repeated rows are one.

    A dimension's range over the whole table is cut into 2^CELL_BITS equal cells (one aggregate
    over the table, as many rows as dimensions). Components beyond a long are the nearest long.
    """
    v = materialize(_vectors(rows, vec_id, embedding).distinct(), "vectors")
    span = v.select(F.size("v").alias("n"), F.posexplode("v").alias("k", "c")).groupBy("n", "k").agg(F.min("c").alias("low"), F.max("c").alias("high")).collect()
    ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    wide = set()
    for n in {r["n"] for r in span}:
        own = sorted((r["k"], r["low"], r["high"]) for r in span if r["n"] == n)
        if max(max(abs(a), abs(b)) for _, a, b in own) ** 2 * n >= 1 << 52:
            wide.add(n)
        ranges[n] = np.array([a for _, a, _ in own], np.int64), np.array([max(1, -(-(b - a + 1) // (1 << CELL_BITS))) for _, a, b in own], np.int64)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                low, step = ranges[len(v)]
                out.append(b"" if len(v) in wide else ((np.array(v, np.int64) - low) // step).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary()), batch.column("v")], names=["vec_id", "cells", "v"])

    return VectorFile(materialize(v.mapInArrow(cells, "vec_id long, cells binary, v array<bigint>"), "va-file"), ranges, wide)


def _merged(have: list, scores, ids: np.ndarray, own: int, k: int) -> list:
    return sorted({*have, *((int(s), -int(d)) for s, d in zip(scores, ids, strict=True) if d != own)}, reverse=True)[:k]


def _best(q: np.ndarray, own: np.ndarray, ids: np.ndarray, cells: np.ndarray, exact: np.ndarray, low: np.ndarray, step: np.ndarray, held: list, k: int) -> None:
    """Update ``held``, the best (score, -vec_id) of each query, with a block of rows.

    The cells give each row an upper bound; exact vectors are read in order of the bounds until
    the next bound is below the kth score.
    """
    floor = low + cells.astype(np.int64) * step
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bound = up @ (floor + step - 1).T.astype(float) + down @ floor.T.astype(float)
    for i in range(len(q)):
        have, at = held[i], 0
        order = None
        while True:
            kth = have[k - 1][0] if len(have) == k else -np.inf
            if order is None:
                near = np.flatnonzero(bound[i] >= kth)
                order = near[np.argsort(-bound[i][near], kind="stable")]
            take = order[at : at + 4 * k]
            take = take[bound[i][take] >= kth]
            if not len(take):
                break
            at += 4 * k
            have = _merged(have, exact[take] @ q[i], ids[take], own[i], k)
        held[i] = have


def _all(q: np.ndarray, own: np.ndarray, ids: np.ndarray, exact: np.ndarray, held: list, k: int) -> None:
    """The same for vectors of very large components: every score, as a whole number held to the range of a long."""
    rows = exact.astype(object)
    for i in range(len(q)):
        scores = [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in rows @ q[i].astype(object)]
        held[i] = _merged(held[i], scores, ids, own[i], k)


def _packed(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to ROW_BLOCK rows of equal length: (grp, size, ids, cells, v) as bytes."""
    at = 0
    for batch in batches:
        sizes = np.asarray(pc.list_value_length(batch.column("v")))
        for size in np.unique(sizes).tolist():
            own = batch.filter(pa.array(sizes == size))
            out = []
            for k in range(0, own.num_rows, ROW_BLOCK):
                part = own.slice(k, ROW_BLOCK)
                ids = np.asarray(part.column("vec_id"))
                out.append(((at + int(ids[0])) % groups, size, ids.astype("<i8").tobytes(), b"".join(part.column("cells").to_pylist()), np.asarray(part.column("v").flatten()).astype("<i8").tobytes()))
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["grp", "size", "ids", "cells", "v"])


def search(file: VectorFile, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query the ``k`` rows of the highest inner product.

    ``queries`` has vec_id and v as in the file's table; a row with the query's own id is no candidate. Ties go
    to the smaller vec_id; with fewer candidates all are returned. Repeated rows of a vec_id take one
    place, or one for each score if their vectors differ; scores beyond a long are the nearest long. Vectors of another
    length than the query's are no candidates.

    The stated query set meets all rows in blocks: blocks of queries go to every group of row blocks, by a join on the
    group. A task goes through its rows for one block of queries after another and returns the best k
    of each query, and these meet once more. Neither queries nor rows pass the driver, and the
    plan is the same for any number of them.
    """
    table, ranges, wide = file.table, file.ranges, file.wide
    n, rows = queries.count(), table.count()
    groups = max(min(-(-rows // (4 * ROW_BLOCK)), 256), -(-rows // GROUP_ROWS), 1)
    blocks = max(1, -(-n // QUERY_BLOCK))

    def pack_queries(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = [], []
        for batch in batches:
            own.append(np.asarray(batch.column("vec_id")).astype("<i8").tobytes())
            q.append(np.asarray(batch.column("v").flatten()).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((key[0].as_py(), pa.int64()), (key[1].as_py(), pa.int32()), (b"".join(own), pa.binary()), (b"".join(q), pa.binary()))], names=["block", "size", "own", "q"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple, tuple[np.ndarray, np.ndarray, list]] = {}

        def told(key: tuple) -> pa.RecordBatch:
            own, _, held = open_.pop(key)
            out = [(int(own[i]), -d, s) for i, have in enumerate(held) for s, d in have]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])

        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                size = column["size"][i].as_py()
                key = (column["block"][i].as_py(), size)
                array = lambda c, t="<i8", i=i, column=column: np.frombuffer(column[c][i].as_buffer(), t)
                if key not in open_:
                    if len(open_) == OPEN_BLOCKS:
                        yield told(next(iter(open_)))
                    own = array("own").copy()
                    q = array("q").reshape(-1, size)
                    open_[key] = own, q.copy() if size in wide else q.astype(float), [[] for _ in own]
                own, q, held = open_[key]
                exact = array("v").reshape(-1, size)
                if size in wide:
                    _all(q, own, array("ids"), exact, held, k)
                else:
                    _best(q, own, array("ids"), array("cells", np.uint8).reshape(-1, size), exact.astype(float), *ranges[size], held, k)
        for key in list(open_):
            yield told(key)

    packed = table.mapInArrow(lambda batches: _packed(batches, groups), "grp int, size int, ids binary, cells binary, v binary")
    placed = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.size("v").alias("size"))
    asked = placed.groupBy("block", "size").applyInArrow(pack_queries, "block long, size int, own binary, q binary")
    asked = asked.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = asked.join(packed.hint("merge"), ["grp", "size"]).mapInArrow(best, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
