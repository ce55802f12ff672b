"""Automata against plain searches."""

import random
import time

import numpy as np
import pytest

from cueforge.functions import matching


def plain_segments(text, words):
    out, at = [], 0
    while at < len(text):
        own = max((w for w in words if w and text.startswith(w, at)), key=len, default=None)
        out.append((own, words.index(own)) if own else (text[at], -1))
        at += len(own or "x")
    return out


def plain_starts(text, word):
    out, at = [], 0
    while word and (at := text.find(word, at)) >= 0:
        out.append(at)
        at += len(word)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_segments_and_occurrences_equal_plain_search(seed):
    r = random.Random(seed)
    for _ in range(400):
        letters = r.choice(("ab", "abc", "一二三é🙂"))
        word = lambda n: "".join(r.choice(letters) for _ in range(n))
        words = [r.choice((None, "", word(r.randrange(1, 6)), word(r.randrange(1, 4)))) for _ in range(r.randrange(7))]
        text = word(r.randrange(30))
        starts, k = (x.tolist() for x in matching.longest_segments(text, words))
        assert list(zip((text[a:b] for a, b in zip(starts, (starts + [len(text)])[1:], strict=True)), k, strict=True)) == plain_segments(text, words)
        assert [x.tolist() for x in matching.occurrences(text, words)] == [plain_starts(text, w) for w in words]


@pytest.mark.parametrize("seed", range(8))
def test_rewriter_equals_the_chain_of_replaces(seed):
    r = random.Random(seed)
    for _ in range(300):
        letters = r.choice(("ab", "abc", "一二三é"))
        word = lambda n: "".join(r.choice(letters) for _ in range(n))
        table = [(word(r.randrange(1, 5)), word(r.randrange(0, 5))) for _ in range(r.randrange(12))]
        rewrite = matching.Rewriter(table)
        for text in (None, "", word(r.randrange(60)), word(r.randrange(60))):
            want = text
            for old, new in table if text else ():
                want = want.replace(old, new)
            assert rewrite(text) == want


def test_five_thousand_phrases():
    r = random.Random(1)
    word = lambda: "".join(chr(0x4E00 + r.randrange(300)) for _ in range(r.randrange(2, 6)))
    table = [(w, "".join(reversed(w))) for w in (word() for _ in range(5000))]
    texts = ["".join(word() for _ in range(2000))] + ["".join(word() for _ in range(20)) for _ in range(300)]
    rewrite = matching.Rewriter(table)
    for text in texts:
        want = text
        for old, new in table:
            want = want.replace(old, new)
        assert rewrite(text) == want
    began = time.process_time()
    matching.Rewriter([(f"w{k}x", "y") for k in range(5000)])("no phrase here " * 70_000)
    assert time.process_time() - began < 3


def test_long_lines_take_linear_time():
    began = time.process_time()
    words = [f"w{k}" for k in range(20_000)]
    text = "".join(words) * 3
    assert (matching.longest_segments(text, words)[1] >= 0).sum() >= 3 * len(words) - 3
    assert sum(map(len, matching.occurrences(text, words))) > 60_000
    assert isinstance(matching.occurrences("aaaa" * 50_000, ["aa"])[0], np.ndarray)
    assert time.process_time() - began < 5
