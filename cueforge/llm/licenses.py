"""License scans: MinHash bands over overlapping windows find templates, containment verifies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.llm.common import slices, split_words, window_hashes
from cueforge.llm.license_texts import templates

#: Templates of more words are looked for in pieces of so many, the last one taken from the end.
PIECE = 40
TEMPLATES = templates()
SHINGLE = 5
#: Bands of one row each. A window that holds 0.8 of a template's shingles has a Jaccard similarity of 0.67 at least and is missed with probability 0.33^16 (2e-8) at most.
BANDS = 16
_FACTORS = np.random.default_rng(5).integers(1, 2**63, BANDS, dtype=np.uint64) | np.uint64(1)


def _normal(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, lower-cased and without marks at its ends; index of the words that have any letter or digit."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    coded = words.dictionary_encode()
    bare = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    table = np.fromiter((xxhash.xxh64_intdigest(w) if w else 0 for w in bare.cast(pa.large_binary()).to_pylist()), np.uint64, len(bare))
    h = table[np.asarray(coded.indices)]
    full = np.flatnonzero(h)
    return h[full], full


def _shingles(h: np.ndarray) -> np.ndarray:
    return window_hashes(h, min(SHINGLE, len(h)))


class _Index:
    """Templates by their number of words: shingle sets, and for each band the sorted values with the templates that have them."""

    def __init__(self, templates: dict[str, str]):
        self.classes: dict[int, list[tuple[str, set, np.ndarray]]] = {}
        for name, text in sorted(templates.items()):
            whole, _ = _normal(split_words(pa.array([text]))[1])
            n = len(whole)
            for k in range(max(1, -(-n // PIECE))):
                first = max(0, min(k * PIECE, n - PIECE))
                h = whole[first : first + PIECE]
                s = _shingles(h)
                if len(s):
                    self.classes.setdefault(len(h), []).append((name if n <= PIECE else f"{name}/{k + 1}", set(s.tolist()), np.array([(s * f).min() for f in _FACTORS])))
        self.bands = {}
        for size, own in self.classes.items():
            values = np.stack([bands for *_, bands in own])
            order = np.argsort(values, axis=0, kind="stable")
            self.bands[size] = [(values[order[:, b], b], order[:, b]) for b in range(BANDS)]

    def matches(self, h: np.ndarray, doc: np.ndarray, share: float) -> Iterator[tuple[int, str, int, int, float]]:
        """(document, template, first, end, containment) of windows that hold a template; overlapping ones give their best."""
        for size, own in self.classes.items():
            k = min(SHINGLE, size)
            s = window_hashes(h, k)
            n = len(h) - size + 1
            if n < 1:
                continue
            met = []
            for f, (values, of) in zip(_FACTORS, self.bands[size], strict=True):
                # The window's least value over its shingles; one shingle needs no minimum.
                low = s * f
                for span in _steps(size - k + 1):
                    low = np.minimum(low[:-span], low[span:])
                low = low[:n]
                left = np.searchsorted(values, low)
                at = np.flatnonzero(values[np.minimum(left, len(values) - 1)] == low)
                many = np.searchsorted(values, low[at], "right") - left[at]
                inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                met.append(of[np.repeat(left[at], many) + inside] * n + np.repeat(at, many))
            pairs = np.unique(np.concatenate(met))
            pairs = pairs[doc[pairs % n] == doc[pairs % n + size - 1]]
            cuts = np.searchsorted(pairs, np.arange(len(own) + 1) * n)
            for t in np.flatnonzero(np.diff(cuts)).tolist():
                name, want, _ = own[t]
                best: tuple[int, int, float] | None = None
                for at in (pairs[cuts[t] : cuts[t + 1]] - t * n).tolist():
                    c = len(want.intersection(s[at : at + size - k + 1].tolist())) / len(want)
                    if c < share:
                        continue
                    if best and (doc[at] != doc[best[0]] or at >= best[0] + size):
                        yield (int(doc[best[0]]), name, best[0], best[0] + size, best[2])
                        best = None
                    if best is None or c > best[2]:
                        best = (at, at + size, c)
                if best:
                    yield (int(doc[best[0]]), name, best[0], best[0] + size, best[2])


def _steps(k: int) -> list[int]:
    """Shifts whose minima in turn cover runs of ``k``."""
    out, span = [], 1
    while span * 2 <= k:
        out.append(span)
        span *= 2
    return [*out, k - span] if k > span else out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, share: float = 0.8) -> DataFrame:
    """Rows (doc_id, template, first_word, end_word, containment) of every place that holds a template.

    A window has as many words as the template and starts at every word; its MinHash bands of
    five-word shingles retrieve templates, and the part of the template's shingles that the window
    holds must be at least ``share``. A template of over 40 words is looked for in pieces of 40, told as ``name/1`` and
    so on, so that an excerpt is found; one of fewer words than a shingle is one shingle, so that a notice of a few
    words is found as it is worded only. Words are
    compared lower-cased, without marks at the ends; places count all words of the text. Null and empty texts have
    no row, an empty table none; repeated rows give repeated results; of templates that hold the same place each has its row.
    """
    index = _Index(templates)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                off, words = split_words(part.column("text"))
                h, place = _normal(words)
                doc = (np.searchsorted(off, place, side="right") - 1).astype(np.int64)
                out = sorted(index.matches(h, doc, share))
                ids = part.column("doc_id").to_pylist()
                cols = [[ids[d] for d, *_ in out], [x[1] for x in out], [int(place[x[2]] - off[x[0]]) for x in out], [int(place[x[3] - 1] - off[x[0]]) + 1 for x in out], [x[4] for x in out]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "template", "first_word", "end_word", "containment"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, template string, first_word long, end_word long, containment double")
