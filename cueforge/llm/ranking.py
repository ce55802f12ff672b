"""Ranked lexical search: one automaton of all items' terms reads the documents, which need no index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueforge.llm.common import discard, materialize, slices

#: Bytes of terms in one automaton, which every Python worker builds; more items are searched in further blocks.
TERM_BYTES = 1 << 20
#: Text is given to the automaton in pieces of about this many bytes.
PIECE_BYTES = 1 << 20
#: Pairs of a document's term and an item, and cells of (document, item), that a task holds at once.
PAIRS, CELLS = 1 << 20, 1 << 22

#: Fixed value: what a term consists of.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8 text as the automaton reads them: small letters, and a blank for whatever bounds a term.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str) -> Column:
    """The terms of a text with their repeats, only A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def _blocks(wanted: DataFrame, term_bytes: int) -> int:
    """Number of hash blocks of items in which each block's terms, but for those of a single item, stay within ``term_bytes``."""
    n = 1
    while True:
        load = wanted.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("b")).agg(F.sum(F.octet_length("term") + 2).alias("bytes"), F.min(F.struct("item_id")).alias("a"), F.max(F.struct("item_id")).alias("z"))
        worst = load.where("a <> z").agg(F.max("bytes")).first()[0] or 0
        if worst <= term_bytes:
            return n
        n *= 2 ** max(1, (worst // term_bytes).bit_length() - 1)


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    """Matches whole terms only: each has a guard on both sides, and neighbours share theirs."""
    machine = ahocorasick.Automaton()
    for k, word in enumerate(words):
        machine.add_word(f" {word.encode().decode('latin-1')} ", k)
    machine.make_automaton()
    return machine


def _counts(texts: pa.Array, machine: ahocorasick.Automaton, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms with repeats of each text; text number, term number and occurrences of each of the automaton's terms in it."""
    raw = pc.fill_null(pc.cast(texts, pa.large_binary()), b"").to_pylist()
    body = b" ".join([b"", *raw, b""]).translate(_FOLD)
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    begin = 1 + np.cumsum(length + 1) - length - 1
    gap = np.frombuffer(body, np.uint8) == 32
    total = np.add.reduceat(~gap[1:] & gap[:-1], begin - 1, dtype=np.int64)
    keys, times, at = [], [], 0
    while at < len(body) - 1:
        end = body.find(b" ", at + PIECE_BYTES)
        end = len(body) - 1 if end < 0 else end
        found = np.fromiter(chain.from_iterable(machine.iter(body[at : end + 1].decode("latin-1"))), np.int64).reshape(-1, 2)
        key, n = np.unique((np.searchsorted(begin, found[:, 0] + at - 1, "right") - 1) * size + found[:, 1], return_counts=True)
        keys.append(key)
        times.append(n)
        at = end
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return total, key // size, key % size, np.bincount(where, np.concatenate(times), len(key)).astype(np.int64)


def _scanned(docs: DataFrame, words) -> DataFrame:
    """Rows (doc_id, n, terms, times): a document's number of terms, and its occurrences of the broadcast ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, size = _automaton(words.value), len(words.value)
        for batch in batches:
            for part in slices(batch):
                n, doc, term, times = _counts(part.column("text"), machine, size)
                off = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (term.astype(np.int32), times)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, times array<bigint>")


def _runs(length: np.ndarray) -> np.ndarray:
    """0, 1, … within each of the consecutive runs."""
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)


class _Best:
    """The ``k`` highest (score, doc_id) of every item so far; a null doc_id comes after all others."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]

    def add(self, score: np.ndarray, doc: np.ndarray, unnamed: np.ndarray) -> None:
        r, item = np.nonzero(score >= self.least)
        if not len(r):
            return
        item, value, doc, unnamed = (np.concatenate(p) for p in zip(self.rows, (item, score[r, item], doc[r], unnamed[r]), strict=True))
        order = np.lexsort((doc, unnamed, -value, item))
        sizes = np.bincount(item, minlength=len(self.least))
        place = _runs(sizes)
        order, place = order[place < self.k], place[place < self.k]
        self.rows = [item[order], value[order], doc[order], unnamed[order]]
        last = place == self.k - 1
        self.least[self.rows[0][last]] = self.rows[1][last]


def _ranked(hits: DataFrame, shared, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Rows (item_id, doc_id, score): the best of each item in each partition of ``hits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weight, off, items = shared.value
        width = np.diff(off)
        best = _Best(len(ids), k)
        for batch in batches:
            lists, times = batch.column("terms"), batch.column("times").flatten().to_numpy()
            term = lists.flatten().to_numpy()
            cut = np.asarray(lists.offsets).astype(np.int64)
            cut -= cut[0]
            doc, unnamed = pc.fill_null(batch.column("doc_id"), 0).to_numpy(), np.asarray(pc.is_null(batch.column("doc_id")))
            m = 50 + 50 * batch.column("n").to_numpy() * n_docs // max(n_terms, 1)
            row = np.repeat(np.arange(batch.num_rows), np.diff(cut))
            value = weight[term] * (1_000_000_000 * times // (1000 * times + 20 * m[row]))
            pairs = np.concatenate(([0], np.cumsum(width[term])))[cut]
            block = np.maximum(pairs[1:] // PAIRS, np.arange(batch.num_rows) * len(ids) // CELLS)
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                i = slice(cut[a], cut[b])
                n = width[term[i]]
                cell = np.repeat(row[i] - a, n) * len(ids) + items[np.repeat(off[term[i]], n) + _runs(n)]
                each = np.repeat(value[i], n)
                sums = lambda x, cell=cell, a=a, b=b: np.bincount(cell, x, (b - a) * len(ids)).astype(np.int64)
                # Two sums, as doubles add whole numbers up to 2^53 only.
                score = sums(each & 0x3FFFFFF) + (sums(each >> 26) << 26)
                best.add(score.reshape(b - a, len(ids)), doc[a:b], unnamed[a:b])
        item, score, doc, unnamed = best.rows
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(item)), pa.array(doc, mask=unnamed), pa.array(score)], ["item_id", "doc_id", "score"])

    return hits.where("size(terms) > 0").select("doc_id", "n", "terms", "times").mapInArrow(run, shared.schema)


class _Shared:
    """A broadcast value and the schema of what is made with it."""

    def __init__(self, sent, schema: str):
        self.sent, self.schema = sent, schema

    @property
    def value(self):
        return self.sent.value


def search(docs: DataFrame, items: DataFrame, k: int = 50, term_bytes: int = TERM_BYTES) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` best documents of every item by a BM25 score in whole numbers.

    An automaton of the items' terms, guarded on both sides, reads each text once and counts. What it finds is stored,
    as a term's weight needs all documents; from it each task keeps the best of every item, and these meet by item. Items
    are searched in blocks of at most ``term_bytes`` of terms (a longer item is a block of its own), each with a pass over the documents.

    Each row is a document, repeated ids and rows included. A null text, or one without terms, counts nowhere; a document
    with a null id is ranked after others of its score. Rows of one item_id (null too) are one item; an item without terms,
    or without a document of a score above 0, has no row, so an empty table gives none. Only doc_id, text and item_id, text are read.
    """
    spark = docs.sparkSession
    wanted = items.select("item_id", F.explode(terms("text")).alias("term")).distinct()
    wanted = materialize(wanted, "item-terms")
    n, found = _blocks(wanted, term_bytes), []
    for b in range(n):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).orderBy("term").toArrow()
        if not own.num_rows:
            continue
        coded, named = own["term"].combine_chunks().dictionary_encode(), own["item_id"].combine_chunks().dictionary_encode("encode")
        words = spark.sparkContext.broadcast(coded.dictionary.to_pylist())
        hits = materialize(_scanned(docs, words), "term-hits")
        n_docs, n_terms = hits.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = hits.select(F.explode("terms").alias("term")).groupBy("term").count()
        weight = np.zeros(len(coded.dictionary), np.int64)
        for r in df.select("term", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("count") + 1))).alias("w")).collect():
            weight[r["term"]] = r["w"]
        # Rows are in order of term: the items of a term follow each other.
        off = np.concatenate(([0], np.cumsum(np.bincount(np.asarray(coded.indices), minlength=len(weight)))))
        shared = spark.sparkContext.broadcast((named.dictionary, weight, off, np.asarray(named.indices).astype(np.int64)))
        kind = wanted.schema["item_id"].dataType.simpleString()
        best = _ranked(hits, _Shared(shared, f"item_id {kind}, doc_id long, score long"), n_docs, n_terms, k)
        place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        found.append(materialize(best.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked"))
        discard(hits)
    discard(wanted)
    if not found:
        return wanted.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
