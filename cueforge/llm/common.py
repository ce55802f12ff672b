"""Helpers shared by the corpus operators: shared storage, batching of texts, word hashes."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are cut into slices of about this many bytes, so that a Python worker's memory has a bound.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only where none is configured (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = _own_dir()
    return where.rstrip("/")


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="cueforge-")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def hash_limit(bound: int, n: int) -> int:
    """Below this value are the 63-bit hashes of ``bound`` of ``n`` rows."""
    return bound * (1 << 63) // max(n, bound, 1) if n > bound else (1 << 63) - 1


def drawn(rows: DataFrame, bound: int, n: int, key: Column, salt: str) -> DataFrame:
    """About ``bound`` of the ``n`` rows, drawn by a 63-bit hash of ``key``; all if they are no more."""
    if n <= bound:
        return rows
    return rows.where(F.xxhash64(key, F.lit(salt)).bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(hash_limit(bound, n)))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts (one narrow aggregate over the column)."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def id_hash_in(n: int, keep, doc_id="doc_id"):
    """Whether crc32(doc_id as text) mod n satisfies ``keep``; a null id counts as remainder 0."""
    return keep(F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n)), F.lit(0)))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about ``limit`` text bytes; a longer text is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    block = (np.cumsum(size) - size) // limit
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [n]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: offsets (one more than texts) and the flat words."""
    parts = pc.ascii_split_whitespace(pc.fill_null(pc.cast(texts, pa.large_string()), ""))
    off = np.asarray(parts.offsets).astype(np.int64)
    words = parts.values.slice(int(off[0]), int(off[-1] - off[0]))
    off = off - off[0]
    if pc.any(pc.equal(words, "")).as_py():
        full = np.asarray(pc.not_equal(words, ""))
        before = np.concatenate(([0], np.cumsum(full)))
        off, words = before[off], words.filter(pa.array(full))
    return off, words


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word; every distinct word of the batch is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    table = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return table[np.asarray(coded.indices)]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two 64-bit hashes, order matters."""
    with np.errstate(over="ignore"):
        z = a * np.uint64(0x9E3779B97F4A7C15) + b
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(32)
    return z


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive hashes, built by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, done, level, span = None, 0, h, 1
    while True:
        if k & span:
            n = len(h) - done - span + 1
            out = level[done : done + n] if out is None else mix(out[:n], level[done : done + n])
            done += span
        if done == k:
            return out
        level = mix(level[:-span], level[span:])
        span *= 2


def sliding(h: np.ndarray, k: int, op) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over each run of ``k``."""
    if len(h) < k:
        return h[:0]
    span = 1
    while span * 2 <= k:
        h = op(h[:-span], h[span:])
        span *= 2
    rest = k - span
    return op(h[:-rest], h[rest:]) if rest else h


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ranges of ``keys`` and sorted: partition after partition they are in order, nulls first, and no key's rows need one task."""
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
