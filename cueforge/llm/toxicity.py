"""Toxicity: cumulative-link ordinal regression over sparse word features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.llm.common import drawn, materialize, slices, split_words

#: Hashed features of each family: the word, and its first five and four characters.
FEATURES = 1 << 20
PREFIXES = (None, 5, 4)
GRADES = 4


def _features(texts: pa.Array, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the distinct features of each text; words are lower-cased, without marks at the ends.

    With ``weight`` only features whose weight isn't zero.
    """
    off, words = split_words(texts)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = words.dictionary_encode()
    bare = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    code, found = np.asarray(coded.indices), []
    span = FEATURES * len(PREFIXES)
    for k, n in enumerate(PREFIXES):
        part = (bare if n is None else pc.utf8_slice_codeunits(bare, 0, n)).dictionary_encode()
        own = np.fromiter((xxhash.xxh64_intdigest(w) % FEATURES + k * FEATURES if w else -1 for w in part.dictionary.cast(pa.large_binary()).to_pylist()), np.int64, len(part.dictionary))
        table = own[np.asarray(part.indices)]
        use = table >= 0 if weight is None else (table >= 0) & (weight[table] != 0)
        keep = np.flatnonzero(use[code])
        doc = np.searchsorted(off, keep, side="right") - 1
        found.append(np.unique(doc * span + table[code[keep]]))
    both = np.unique(np.concatenate(found))
    return both // span, both % span


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class OrdinalModel:
    """P(grade >= j) = sigmoid(score - cut_j); one weight vector for all cuts."""

    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.array([2.0, 4.0, 6.0]))

    def dense(self) -> np.ndarray:
        w = np.zeros(FEATURES * len(PREFIXES))
        w[self.index] = self.value
        return w

    def predict(self, texts: pa.Array, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity and P(grade >= 1) of each text."""
        doc, f = _features(texts, w)
        s = np.bincount(doc, weights=w[f], minlength=len(texts))
        over = _sigmoid(s[:, None] - self.cuts)
        return over.sum(axis=1), over[:, 0]


def _train(doc: np.ndarray, f: np.ndarray, grade: np.ndarray, rounds: int = 400, rate: float = 0.1, decay: float = 2e-5) -> OrdinalModel:
    """Adam on the mean likelihood loss, each kind of label weighing half, with a small decay of the weights."""
    ids, col = np.unique(f, return_inverse=True)
    n, m = len(grade), len(ids)
    share = np.clip((grade > 0).mean(), 1e-3, 1 - 1e-3)
    weight = np.where(grade > 0, 0.5 / share, 0.5 / (1 - share)) / n
    x = np.concatenate((np.zeros(m), [2.0], np.zeros(GRADES - 2)))  # weights, first cut, logarithms of the gaps
    a, b = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        s = np.bincount(doc, weights=x[:m][col], minlength=n)
        gaps = np.exp(x[m + 1 :])
        cuts = x[m] + np.concatenate(([0], np.cumsum(gaps)))
        edge = np.concatenate(([-np.inf], cuts, [np.inf]))
        high = np.where(grade == GRADES - 1, 1.0, _sigmoid(np.nan_to_num(edge[grade + 1] - s, posinf=30)))
        low = np.where(grade == 0, 0.0, _sigmoid(np.nan_to_num(edge[grade] - s, neginf=-30)))
        p = np.maximum(high - low, 1e-9)
        # The loss of a text is -log(high - low); both ends move against the score.
        g = np.bincount(col, weights=((1 - low - high) * weight)[doc], minlength=m) + decay * x[:m]
        dc = np.zeros(GRADES - 1)
        np.add.at(dc, np.minimum(grade, GRADES - 2), np.where(grade < GRADES - 1, -high * (1 - high) / p, 0) * weight)
        np.add.at(dc, np.maximum(grade - 1, 0), np.where(grade > 0, low * (1 - low) / p, 0) * weight)
        d = np.concatenate((g, [dc.sum()], np.cumsum(dc[::-1])[::-1][1:] * gaps))
        a, b = 0.9 * a + 0.1 * d, 0.999 * b + 0.001 * d * d
        x -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-10)
    w = x[:m]
    return OrdinalModel(ids[w != 0], w[w != 0], x[m] + np.concatenate(([0], np.cumsum(np.exp(x[m + 1 :])))))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 15_000) -> OrdinalModel:
    """Train on at most about ``bound`` labelled documents, drawn by a hash of doc_id.

    A feature is indicative if its share among documents labelled 1 is over e^2 times that among
    the others and it is in at least 0.4 % of the former; only these are weighed. The grade of a document labelled 1
    is its number of indicative features of one family, 1 to 3. The sample is counted by Spark; the driver gets the
    indicative features and those of each sampled text. Equal texts count once. Null labels and ids take no part; several
    labels of a document count as their greatest. Without labels of both kinds the model has no weights and calls nothing toxic.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = drawn(marks, bound, marks.count(), F.col("doc_id"), "toxic")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(marks, "doc_id").select("text", "toxic").distinct()
    sample = materialize(sample, "toxic-sample")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = n.pop(1, 0), sum(n.values())
    if not n1 or not n0:
        return OrdinalModel()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc, f = _features(part.column("text"))
                toxic = np.asarray(part.column("toxic")) == 1
                ids, at = np.unique(f, return_inverse=True)
                n1 = np.bincount(at, weights=toxic[doc], minlength=len(ids)).astype(np.int64)
                n0 = np.bincount(at, minlength=len(ids)).astype(np.int64) - n1
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, n1, n0)], names=["f", "n1", "n0"])

    in1, in0 = F.col("n1"), F.col("n0")
    gain = F.log((in1 + 0.5) / (n1 + 1)) - F.log((in0 + 0.5) / (n0 + 1))
    found = sample.mapInArrow(counts, "f long, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    told = np.array(sorted(r["f"] for r in found.where((in1 >= max(3, 0.004 * n1)) & (gain > 2)).select("f").collect()), np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(FEATURES * len(PREFIXES), np.uint8)
        mask[told] = 1
        for batch in batches:
            for part in slices(batch):
                doc, f = _features(part.column("text"), mask)
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                own = [f[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(own, pa.binary())], names=["toxic", "f"])

    got = sorted((r["f"], r["toxic"]) for r in sample.mapInArrow(rows, "toxic int, f binary").collect())
    toxic = np.array([t for _, t in got], np.int64)
    f = np.frombuffer(b"".join(x for x, _ in got), "<i4").astype(np.int64)
    doc = np.repeat(np.arange(len(got)), [len(x) // 4 for x, _ in got])
    most = np.stack([np.bincount(doc[f // FEATURES == k], minlength=len(got)) for k in range(len(PREFIXES))]).max(axis=0)
    return _train(doc, f, np.where(toxic == 1, np.clip(most, 1, GRADES - 1), 0))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """Rows (doc_id, severity, toxic), one per document.

    severity is the expected grade, 0 to 3; toxic is 1 if a grade of at least 1 is likelier than not. Null and
    empty texts have no features: their severity is that of the cuts alone. Rows that repeat a doc_id are scored one
    by one, equal texts alike; an empty table gives none; other columns, whatever their names, don't matter.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.dense()
        for batch in batches:
            for part in slices(batch):
                severity, p = model.predict(part.column("text"), w)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(severity, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "severity", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, severity double, toxic int")
