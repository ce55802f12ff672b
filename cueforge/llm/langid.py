"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueforge.llm.common import drawn, slices

DIM = 1024
#: Grid of a document's unit vector in the sums.
UNIT = 1 << 36
GRAM = 3
#: Texts bundled at once.
BUNDLE = 192
#: Letters looked at at once; longer texts are counted in pieces that are added up.
PIECE = 400_000
GAP = 0


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


#: Vectors of letters and n-grams that a worker remembers, of DIM bytes each.
KEPT = 40_000


@functools.lru_cache(maxsize=KEPT)
def letter_vector(code: int) -> np.ndarray:
    """The random bipolar vector of a code point (GAP stands between words); the same on every machine."""
    return np.random.default_rng([11, code]).integers(0, 2, DIM, dtype=np.int8) * np.int8(2) - np.int8(1)


@functools.lru_cache(maxsize=KEPT)
def gram_vector(gram: tuple[int, ...]) -> np.ndarray:
    """Bound n-gram: the product of its letters' vectors, each permuted by its place."""
    out = np.ones(DIM, np.int8)
    for place, code in enumerate(gram):
        out = out * np.roll(letter_vector(code), GRAM - 1 - place)
    return out


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the n-gram vectors of each text, and its number of letters.

    Letters are lower-cased; each run of other characters is one gap, as are both ends.
    """
    out, letters = np.zeros((len(texts), DIM), np.float64), np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and upto - at < BUNDLE and (upto == at or size + len(texts[upto] or "") <= PIECE):
            size += len(texts[upto] or "")
            upto += 1
        _add(texts[at:upto], out[at:upto], letters[at:upto])
        at = upto
    return out, letters


def _add(texts: list[str | None], out: np.ndarray, letters: np.ndarray) -> None:
    lower = [(t or "").lower() for t in texts]
    doc = np.repeat(np.arange(len(lower)), [len(t) + 2 for t in lower])
    code = np.frombuffer("".join(f" {t} " for t in lower).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    isl = _is_letter()[code]
    letters += np.bincount(doc[isl], minlength=len(lower))
    code[~isl] = GAP
    keep = np.concatenate(([True], isl[1:] | isl[:-1] | (doc[1:] != doc[:-1])))
    code, doc = code[keep], doc[keep]
    known, small = np.unique(code, return_inverse=True)
    m = len(known)
    for a in range(0, max(0, len(code) - GRAM + 1), PIECE):
        s, d = small[a : a + PIECE + GRAM - 1].astype(np.int64), doc[a : a + PIECE + GRAM - 1]
        if len(s) < GRAM:
            break
        gram = s[: len(s) - GRAM + 1].copy()
        for k in range(1, GRAM):
            gram = gram * m + s[k : len(s) - GRAM + 1 + k]
        ok = d[: len(gram)] == d[GRAM - 1 :]
        gram, own = gram[ok], d[: len(ok)][ok]
        ids, col = np.unique(gram, return_inverse=True)
        # Each text's trigrams with their counts, in order of trigram: only a block of them is laid out as a matrix.
        pair, n = np.unique(col * len(lower) + own, return_counts=True)
        col, own = pair // len(lower), pair % len(lower)
        for b in range(0, len(ids), 8192):
            part = ids[b : b + 8192]
            block = slice(*np.searchsorted(col, (b, b + len(part))))
            counts = np.zeros((len(lower), len(part)), np.float32)
            counts[own[block], col[block] - b] = n[block]
            places = np.stack([known[part // m ** (GRAM - 1 - k) % m] for k in range(GRAM)], axis=1)
            out += counts @ np.stack([gram_vector(tuple(g)) for g in places.tolist()]).astype(np.float32)


@dataclass
class Profiles:
    """Language prototypes: rows of unit length, after taking off what all languages share."""

    names: list[str]
    mean: np.ndarray
    rows: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        v, letters = bundles(texts)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) - self.mean
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        # Row by row: a matrix product's last bits depend on how many texts are scored together.
        cos = np.stack([(v * row).sum(axis=1) for row in self.rows], axis=1)
        best = cos.argmax(axis=1)
        score = np.where(letters > 0, np.clip((1 + cos[np.arange(len(texts)), best]) / 2, 0, 1), 0.0)
        return [self.names[k] if n else "und" for k, n in zip(best, letters, strict=True)], score


def fit(docs: DataFrame, bound: int = 20_000) -> Profiles:
    """Prototype of each language from at most about ``bound`` documents with a language, drawn by a hash of doc_id.

    A prototype is the sum of the unit vectors of its documents. Null languages and documents
    without a letter take no part; with none left every prediction is 'und'. The driver holds one prototype (8 kB) for
    each language of the sample, at most ``bound``.
    """
    known = docs.where("lang is not null")
    sample = drawn(known, bound, known.count(), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "lang")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                v, letters = bundles(part.column("text").to_pylist())
                # Whole numbers, so that sums are the same in any order.
                v = np.rint(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) * UNIT).astype(np.int64)
                lang = np.array(part.column("lang").to_pylist(), dtype=object)
                for name in set(lang[letters > 0]):
                    sums[name] = sums.get(name, 0) + v[(lang == name) & (letters > 0)].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = sample.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "lang string, v array<long>")
    flat = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    got = sorted(flat.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).collect(), key=lambda r: r["lang"])
    if not got:
        return Profiles([], np.zeros(DIM), np.zeros((0, DIM)))
    rows_ = np.array([[x["x"] for x in r["v"]] for r in got], float)
    rows_ /= np.maximum(np.linalg.norm(rows_, axis=1, keepdims=True), 1e-12)
    mean = rows_.mean(axis=0) if len(got) > 1 else np.zeros(DIM)
    rows_ = rows_ - mean
    return Profiles([r["lang"] for r in got], mean, rows_ / np.maximum(np.linalg.norm(rows_, axis=1, keepdims=True), 1e-12))


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Rows (doc_id, lang_pred, score), one per document, from every letter of the whole text.

    score is the cosine to the best prototype moved to 0..1; a null text or one without a letter
    is 'und' with score 0. Ties go to the first language by name. Rows are independent: repeated rows give repeated
    results, an empty table none, and how the rows are partitioned changes no bit of a score.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                names, score = profiles.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, schema)
