"""Substring de-duplication: a count-min prefilter, then exact grouping of what may repeat."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.llm.common import hash_words, mix, slices, sliding, split_words, text_bytes, window_hashes

#: Cells of one row of the sketch: four for each expected anchor, between these bounds. Only the
#: bits "counted twice" of both rows are broadcast: 64 MB at the upper bound.
LEAST_WIDTH, MOST_WIDTH = 1 << 20, 1 << 28
#: Cells of a shard of the sketch, as one reducer merges them.
SHARD_BITS = 20
#: Distinct anchors that a task holds before it emits what it has of its sketch.
FLUSH = 2_000_000
#: Text bytes for each group of the exact pass, and for each bucket of documents whose runs are gathered.
GROUP_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20


class _Windows:
    """The windows of some documents' words, flat: validity and anchor of each start."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        gram = window // 2
        off, words = split_words(batch.column("text"))
        self.words_of = np.diff(off)
        self.h = hash_words(words)
        self.doc = np.repeat(np.arange(batch.num_rows), self.words_of)
        self.start = off[:-1]
        n = max(0, len(self.h) - window + 1)
        self.grams = window_hashes(self.h, gram)
        self.reach = window - gram + 1
        self.anchor = sliding(self.grams, self.reach, np.minimum)[:n]
        self.valid = self.doc[:n] == self.doc[window - 1 : window - 1 + n]

    def anchors(self) -> np.ndarray:
        """Hashes of the grams that are the least of some window, once for each place."""
        if not len(self.anchor):
            return self.anchor
        least = np.where(self.valid, self.anchor, np.uint64(0))
        edge = np.zeros(self.reach - 1, np.uint64)
        most = sliding(np.concatenate((edge, least, edge)), self.reach, np.maximum)
        return self.grams[most == self.grams]


def _cells(h: np.ndarray, width: int) -> np.ndarray:
    """The cell of each hash in either row of the sketch, the second row after the first."""
    low = h & np.uint64(width - 1)
    return np.stack((low, ((h >> np.uint64(32)) & np.uint64(width - 1)) + np.uint64(width))).astype(np.uint32)


def _width(size: int) -> int:
    return min(MOST_WIDTH, max(LEAST_WIDTH, 1 << max(0, int(size / 9)).bit_length()))


def _pack(x: np.ndarray) -> bytes:
    """Sorted cells as differences, equal bytes together, so that shuffle compression works."""
    return np.diff(x, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32)


def sketch(docs: DataFrame, window: int, width: int) -> DataFrame:
    """Rows (shard, twice): the merged count-min sketch, one bit a cell for a count of two or more.

    A window is counted by its anchor, the least hash among its half-length grams: windows of the
    same words have the same anchor, so the count of the anchor is never below that of the window.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit() -> pa.RecordBatch:
            cells, n = np.unique(np.concatenate([c.ravel() for c in held]), return_counts=True)
            held.clear()
            shard = cells >> np.uint32(SHARD_BITS)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
            rows = [(int(shard[a]), _pack(cells[a:b] & np.uint32((1 << SHARD_BITS) - 1)), np.packbits(n[a:b] > 1).tobytes()) for a, b in itertools.pairwise(cuts.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "cells", "twice"])

        for batch in batches:
            for part in slices(batch):
                a = _Windows(part, window).anchors()
                if len(a):
                    held.append(_cells(a, width))
                if sum(x.size for x in held) > 2 * FLUSH:
                    yield emit()
        if held:
            yield emit()

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(1 << SHARD_BITS, bool), np.zeros(1 << SHARD_BITS, bool)
        for batch in batches:
            for cells, more in zip(batch.column("cells").to_pylist(), batch.column("twice").to_pylist(), strict=True):
                at = _unpack(cells)
                twice[at] |= once[at] | np.unpackbits(np.frombuffer(more, np.uint8), count=len(at)).astype(bool)
                once[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], names=["shard", "twice"])

    parts = docs.mapInArrow(partial, "shard int, cells binary, twice binary")
    return parts.groupBy("shard").applyInArrow(merge, "shard int, twice binary")


def _spread(doc: np.ndarray, at: np.ndarray, window: int, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Windows as (bucket, documents, first and last starts of runs whose windows touch), packed by bucket of documents."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (np.diff(at) > window)))[: len(doc)]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(doc) - 1]))[: len(first)]
    doc, at = doc[first], np.stack((at[first], at[last]), axis=1).astype("<i4")
    # Mixed, so that ids of a common stride spread over all buckets.
    bucket = (mix(doc.astype(np.uint64), np.full(len(doc), np.uint64(0x5851F42D4C957F2D))) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, doc, at = bucket[order], doc[order].astype("<i8"), at[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, int)
    for a, b in itertools.pairwise(cuts.tolist()):
        yield int(bucket[a]), doc[a:b].tobytes(), at[a:b].tobytes()


def _later(doc: np.ndarray, at: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of windows ordered by words, then place: those that start after the first of their words."""
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    return same & ((doc != doc[first]) | (at != at[first]))


def repeated_runs(docs: DataFrame, window: int = 20) -> DataFrame:
    """Rows (doc_id, runs): word ranges covered by windows that also start earlier, for documents that have any.

    First pass: the sketch (see ``sketch``). Second pass: windows estimated to repeat; in each slice of
    documents all but the first of equal windows are decided there, so a passage that a third of
    the corpus holds costs one entry a slice. The firsts meet by hash and are ordered exactly
    (96 hash bits stand for the words). Rows with a null doc_id take no part.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    spark = docs.sparkSession
    size = text_bytes(docs)
    width, groups, buckets = _width(size), max(12, size // GROUP_BYTES), max(12, size // BUCKET_BYTES)
    bits = np.zeros(2 * width // 8, np.uint8)
    step = (1 << SHARD_BITS) // 8
    for row in sketch(docs, window, width).toLocalIterator():
        bits[row.shard * step : (row.shard + 1) * step] = np.frombuffer(row.twice, np.uint8)
    twice = spark.sparkContext.broadcast(bits)
    names = ["part", "bucket", "words", "more", "docs", "at"]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]

    def rows(columns: list[list], names: list[str] = names, types: list[pa.DataType] = types) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = twice.value
        for batch in batches:
            for part in slices(batch):
                part = part.take(pc.sort_indices(part.column("doc_id")))
                x = _Windows(part, window)
                maybe = x.valid.copy()
                for cell in _cells(x.anchor, width):
                    maybe &= ((seen[cell >> np.uint32(3)] >> (cell & np.uint32(7)).astype(np.uint8)) & 1).astype(bool)
                i = np.flatnonzero(maybe)
                if not len(i):
                    continue
                words = mix(x.grams[i], x.grams[i + window // 2])
                order = np.argsort(words, kind="stable")
                i, words = i[order], words[order]
                more = (mix(x.grams[i + window // 2], x.grams[i]) >> np.uint64(32)).astype("<u4")
                doc = np.asarray(part.column("doc_id"))[x.doc[i]]
                at = (i - x.start[x.doc[i]]).astype(np.int64)
                same = np.concatenate(([False], (words[1:] == words[:-1]) & (more[1:] == more[:-1])))
                later = _later(doc, at, same)
                for bucket, docs_, at_ in _spread(doc[later], at[later], window, buckets):
                    yield rows([[bucket % groups], [bucket], [None], [None], [docs_], [at_]])
                i, words, more, doc, at = (y[~same] for y in (i, words, more, doc, at))
                to = (words % np.uint64(groups)).astype(np.int64)
                order = np.lexsort((i, to))
                to, words, more, doc, at = (y[order] for y in (to, words, more, doc, at))
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)]))
                out = [(int(to[a]), words[a:b].astype("<u8").tobytes(), more[a:b].tobytes(), doc[a:b].astype("<i8").tobytes(), at[a:b].astype("<i4").tobytes()) for a, b in itertools.pairwise(cuts.tolist())]
                p, w, m, d, a = (list(y) for y in zip(*out, strict=True))
                yield rows([p, [None] * len(p), w, m, d, a])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {k: [] for k in ("words", "more", "docs", "at")}
        for batch in batches:
            told = pc.is_valid(batch.column("bucket"))
            known = batch.filter(told)
            if known.num_rows:
                yield known.select(["bucket", "docs", "at"])
            batch = batch.filter(pc.invert(told))
            for k, v in held.items():
                v += batch.column(k).to_pylist()
        words, more, doc, at = (np.frombuffer(b"".join(held[k]), t) for k, t in (("words", "<u8"), ("more", "<u4"), ("docs", "<i8"), ("at", "<i4")))
        order = np.lexsort((at, doc, more, words))
        words, more, doc, at = words[order], more[order], doc[order], at[order].astype(np.int64)
        same = np.concatenate(([False], (words[1:] == words[:-1]) & (more[1:] == more[:-1])))[: len(words)]
        later = _later(doc, at, same)
        out = list(zip(*_spread(doc[later], at[later], window, buckets), strict=True)) or [(), (), ()]
        yield rows(out, names[1:2] + names[4:], types[1:2] + types[4:])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[bytes], list[bytes]] = ([], [])
        for batch in batches:
            for v, k in zip(held, ("docs", "at"), strict=True):
                v += batch.column(k).to_pylist()
        doc, at = np.frombuffer(b"".join(held[0]), "<i8"), np.frombuffer(b"".join(held[1]), "<i4").reshape(-1, 2)
        order = np.argsort(doc, kind="stable")
        doc, at = doc[order], at[order] + np.array([0, window], "<i4")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)])).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([int(doc[a]) for a in cuts[:-1]], pa.int64()), pa.array([at[a:b].tobytes() for a, b in itertools.pairwise(cuts)], pa.binary())], names=["doc_id", "runs"])

    met = docs.mapInArrow(candidates, "part int, bucket int, words binary, more binary, docs binary, at binary")
    later = met.groupBy("part").applyInArrow(exact, "bucket int, docs binary, at binary")
    return later.groupBy("bucket").applyInArrow(gather, "doc_id long, runs binary")


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept), one per document; kept is the words left, joined by a space.

    A word goes when a window of ``window`` words that covers it also starts earlier (smaller
    doc_id, or the same document and an earlier start). Null and empty texts have no words; a
    document shorter than a window, or with a null doc_id, stays whole.
    """
    gone = repeated_runs(docs, window)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: list[tuple[int, int, str]] = []
                for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    n = len(words)
                    if runs:
                        keep = np.ones(n + 1, bool)
                        step = np.zeros(n + 1, np.int64)
                        ends = np.frombuffer(runs, "<i4").reshape(-1, 2)
                        np.add.at(step, ends[:, 0], 1)
                        np.add.at(step, ends[:, 1], -1)
                        keep = (np.cumsum(step) == 0)[:n]
                        words = list(itertools.compress(words, keep.tolist()))
                    out.append((n, n - len(words), b" ".join(words).decode()))
                n, m, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return docs.join(gone, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
