"""Many words against a text at once: automata of a line's own words or of a phrase table."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Sequence
from itertools import chain

import ahocorasick
import numpy as np


def automaton(words: Iterable[str]) -> ahocorasick.Automaton | None:
    """Trie with failure links; a word's value is its first place in ``words``. Empty words are left out; None without any."""
    machine = ahocorasick.Automaton()
    for k, word in enumerate(words):
        if word and word not in machine:
            machine.add_word(word, k)
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


def longest_segments(text: str, words: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and words of the parts of ``text`` from left to right: the longest word that begins at a place, as its first place in ``words``, else one character and -1."""
    machine = automaton(w or "" for w in words)
    if machine is None:
        return np.arange(len(text)), np.full(len(text), -1)
    best = np.full(len(text), -1)
    after = np.arange(1, len(text) + 1)
    found = np.fromiter(chain.from_iterable(machine.iter(text)), np.int64).reshape(-1, 2)
    length = np.array([len(w or "") for w in words])[found[:, 1]]
    order = np.argsort(length, kind="stable")
    begin = (found[:, 0] + 1 - length)[order]
    # Of several at a place the last one stays, the longest.
    best[begin] = found[order, 1]
    after[begin] = begin + length[order]
    onward, starts, at = after.tolist(), [], 0
    while at < len(text):
        starts.append(at)
        at = onward[at]
    starts = np.array(starts, np.int64)
    return starts, best[starts]


def occurrences(text: str, words: Sequence[str | None]) -> list[np.ndarray]:
    """Starts of the occurrences of each word, none overlapping another of the same word; equal words have equal starts."""
    none = np.zeros(0, np.int32)
    machine = automaton(w or "" for w in words)
    found = np.fromiter(chain.from_iterable(machine.iter(text)) if machine else (), np.int64).reshape(-1, 2)
    order = np.argsort(found[:, 1], kind="stable")
    k, end = found[order, 1], found[order, 0]
    own: dict[str, np.ndarray] = {}
    cuts = np.flatnonzero(np.diff(k)) + 1
    for own_end, which in zip(np.split(end, cuts), np.split(k, cuts), strict=True):
        if not len(which):
            continue
        word = words[int(which[0])]
        starts = own_end + 1 - len(word)
        if (np.diff(starts) < len(word)).any():
            kept, free = [], 0
            for s in starts.tolist():
                if s >= free:
                    kept.append(s)
                    free = s + len(word)
            starts = np.array(kept)
        own[word] = starts.astype(np.int32)
    return [own.get(w, none) if w else none for w in words]


class Rewriter:
    """An ordered table of phrases, each replaced everywhere before the next one is looked at.

    Only phrases that occur are looked at: the automaton finds them once, and after a replacement again where the text has changed. A phrase
    that comes into being before its turn is replaced at its turn, one whose turn is over stays.
    """

    def __init__(self, table: Sequence[tuple[str, str]]):
        self.table = list(table)
        self.ranks: dict[str, list[int]] = {}
        for k, (old, _) in enumerate(self.table):
            self.ranks.setdefault(old, []).append(k)
        self.machine = automaton(old for old, _ in self.table)
        self.reach = max((len(old) for old, _ in self.table), default=1) - 1

    def _seen(self, text: str) -> set[int]:
        return {k for _, k in self.machine.iter(text)}

    def __call__(self, text: str | None) -> str | None:
        if not text or self.machine is None:
            return text
        # Turns to come, in order; equal phrases have several.
        turns = sorted(r for k in self._seen(text) for r in self.ranks[self.table[k][0]])
        at = 0
        while at < len(turns):
            rank = turns[at]
            at += 1
            old, new = self.table[rank]
            parts = text.split(old)
            if len(parts) == 1:
                continue
            text = new.join(parts)
            fresh: set[int] = set()
            begin = end = None
            place = 0
            for part in parts[:-1]:
                place += len(part)
                low, high = max(place - self.reach, 0), place + len(new) + self.reach
                place += len(new)
                if end is not None and low <= end:
                    end = high
                    continue
                if end is not None:
                    fresh |= self._seen(text[begin:end])
                begin, end = low, high
            fresh |= self._seen(text[begin:end])
            for r in {r for k in fresh for r in self.ranks[self.table[k][0]] if r > rank}:
                i = bisect_left(turns, r, at)
                if i == len(turns) or turns[i] != r:
                    insort(turns, r, at)
        return text
