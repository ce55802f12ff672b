"""Quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueforge.llm.common import drawn, hash_words, slices, split_words

#: Words of a passage.
PASSAGE = 64
#: Classes of bytes whose shares describe a passage.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b"!?", b"|", b"#$%&*@^~", b"<>{}[]()=/\\", b"-_+:;'\"`", b"\n\r")
SHAPES = ("words", "mean_length", "long_words", "short_words", "distinct", "top_word", "repeat_next", "ends_marked")
#: Buckets into which a passage's words are hashed.
BUCKETS = 32
PLAIN = len(CLASSES) + 2 + len(SHAPES)
N = PLAIN + BUCKETS

_CLASS = np.full(256, len(CLASSES), np.uint8)
for _k, _c in enumerate(CLASSES):
    _CLASS[list(_c)] = _k
_CLASS[128:] = len(CLASSES) + 1


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and for each text the index of its first (one more entry than texts).

    Every text has at least one passage; that of an empty or null text is all zero.
    """
    off, words = split_words(texts)
    count = np.diff(off)
    per_doc = np.maximum(1, -(-count // PASSAGE))
    first = np.concatenate(([0], np.cumsum(per_doc)))
    n = int(first[-1])
    out = np.zeros((n, N), np.float64)
    if not len(words):
        return out, first
    inside = np.arange(len(words)) - np.repeat(off[:-1], count)
    passage = np.repeat(first[:-1], count) + inside // PASSAGE
    coded = pc.utf8_lower(words).dictionary_encode()
    code = np.asarray(coded.indices).astype(np.int64)
    size = np.asarray(pc.utf8_length(words)).astype(np.float64)
    raw = pc.cast(words, pa.large_binary())
    edges = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    kinds = _CLASS[data]
    k = len(CLASSES) + 2
    slot = np.repeat(passage * k, np.diff(edges)) + kinds
    shares = np.bincount(slot, minlength=n * k).reshape(n, k).astype(np.float64)
    total = np.maximum(shares.sum(axis=1), 1)
    held = np.bincount(passage, minlength=n).astype(np.float64)
    some = np.maximum(held, 1)
    out[:, :k] = np.sqrt(shares / total[:, None])
    per = lambda x: np.bincount(passage, weights=x, minlength=n) / some
    pairs, times = np.unique(passage * len(coded.dictionary) + code, return_counts=True)
    owner = pairs // len(coded.dictionary)
    most = np.zeros(n)
    np.maximum.at(most, owner, times)
    again = np.concatenate(([False], (code[1:] == code[:-1]) & (passage[1:] == passage[:-1])))
    last = kinds[np.maximum(edges[1:] - 1, 0)]
    bucket = (hash_words(coded.dictionary, 7) % np.uint64(BUCKETS)).astype(np.int64)[code]
    out[:, PLAIN:] = np.sqrt(np.bincount(passage * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS) / some[:, None])
    out[:, k:PLAIN] = np.stack([np.minimum(held / PASSAGE, 1), per(size) / 10, per(size > 14), per(size <= 2), np.bincount(owner, minlength=n) / some, most / some, per(again), per((last > 2) & (last < len(CLASSES)))], axis=1)
    return out, first


class AttentionModel:
    """Gated attention over encoded passages, trained from document labels."""

    def __init__(self, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(N), np.ones(N)
        self.p = {"E": r.normal(0, N**-0.5, (N, hidden)), "e": np.zeros(hidden), "V": r.normal(0, hidden**-0.5, (hidden, hidden)), "U": r.normal(0, hidden**-0.5, (hidden, hidden)), "w": r.normal(0, hidden**-0.5, hidden), "c": np.zeros(hidden), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        """Everything up to the document scores; passages of a document are consecutive."""
        p, at = self.p, first[:-1]
        bag = np.repeat(np.arange(len(at)), np.diff(first))
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        a = np.exp(s - np.maximum.reduceat(s, at)[bag])
        a /= np.add.reduceat(a, at)[bag]
        m = np.add.reduceat(a[:, None] * h, at, axis=0)
        y = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["b"], -30, 30)))
        return {"bag": bag, "at": at, "z": z, "h": h, "t": t, "g": g, "a": a, "m": m, "y": y}

    def slopes(self, f: dict, label: np.ndarray, weight: np.ndarray) -> dict:
        """Gradient of the weighted cross entropy."""
        p, bag = self.p, f["bag"]
        dy = (f["y"] - label) * weight
        dm = dy[:, None] * p["c"]
        da = (dm[bag] * f["h"]).sum(axis=1)
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, f["at"])[bag])
        dt, dg = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dm[bag] + dt @ p["V"].T + dg @ p["U"].T
        dz = dh * (1 - f["h"] ** 2)
        return {"E": f["z"].T @ dz, "e": dz.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["m"].T @ dy, "b": np.array([dy.sum()])}

    def fit(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 5e-3, seed: int = 7) -> None:
        """Adam over batches of documents; the two labels weigh the same in total."""
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
        weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        size = np.diff(first)
        for _ in range(epochs):
            order = r.permutation(len(label))
            for at in range(0, len(order), batch):
                docs = order[at : at + batch]
                own = np.concatenate(([0], np.cumsum(size[docs])))
                rows = np.repeat(first[docs] - own[:-1], size[docs]) + np.arange(own[-1])
                d = self.slopes(self.forward(x[rows], own), label[docs], weight[docs] / len(docs))
                step += 1
                for k, w in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * d[k]
                    v[k] = 0.999 * v[k] + 0.001 * d[k] ** 2
                    w -= rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + 1e-4 * w)

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["y"]


def fit(docs: DataFrame, labels: DataFrame, bound: int = 12_000) -> AttentionModel:
    """Train on all passages of at most about ``bound`` labelled documents.

    The sample is drawn by a hash of doc_id; a document with several labels counts once, with the
    smallest. Null labels and ids take no part. With no label of either kind the model is untrained
    (every score one half).
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    marks = drawn(marks, bound, marks.count(), F.col("doc_id"), "quality")
    bags = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(marks, "doc_id").select("text", "quality")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x, first = passages(part.column("text"))
                own = [x[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(own, pa.binary())], names=["quality", "x"])

    model = AttentionModel()
    got = bags.mapInArrow(rows, "quality int, x binary").collect()
    label = np.array([r["quality"] for r in got], float)
    if len(set(label.tolist())) < 2:
        return model
    order = sorted(range(len(got)), key=lambda i: (got[i]["x"], label[i]))
    x = [np.frombuffer(got[i]["x"], "<f4").reshape(-1, N) for i in order]
    model.fit(np.concatenate(x).astype(float), np.concatenate(([0], np.cumsum([len(y) for y in x]))), label[order])
    return model


def score(docs: DataFrame, model: AttentionModel, out: str = "score") -> DataFrame:
    """``docs`` with ``out`` (0 to 1) from every passage of the whole text; null and empty texts too.

    Rows are independent: repeated rows give repeated results, an empty table none. A column named
    ``out`` is replaced."""
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    text = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x, first = passages(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x, first), pa.float64())], names=[*part.schema.names, out])

    return docs.mapInArrow(rows, schema)
