"""Conversation repair, chat formatting and ranked search against brute force on small tables."""

import hashlib
import heapq
import math
import os
import random
import re

import duckdb
import pytest

from cueforge.llm import chat, ranking, repair
from cueforge.llm.queries import ORACLES, QUERIES

TURNS = "conv_id long, turn long, role string, text string, conv string, key string"
TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_ranked_search", "op13_chat_format"])
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(TABLES):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{TABLES}/{f}'")
    got = QUERIES[name](spark, TABLES)
    want = c.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


# 11 conversation repair


def cheapest(rows):
    """(cost, edits, what remains) by Dijkstra over (rows read, state), ties by the edits' letters. A row: (role, text, must go, truncated)."""
    todo, seen = [(0, "", 0, 0, ())], set()
    while todo:
        cost, edits, k, q, out = heapq.heappop(todo)
        if k == len(rows) and q in (0, 3):
            return cost, edits, list(out)
        if (k, q) in seen:
            continue
        seen.add((k, q))
        t, named = (3, "assistant") if q == 2 else (2, "user")
        heapq.heappush(todo, (cost + 3, edits + "I", k, t, (*out, (named, ""))))
        if k < len(rows):
            role, text, gone, cut = rows[k]
            heapq.heappush(todo, (cost + 4, edits + "D", k + 1, q, out))
            if not gone:
                heapq.heappush(todo, (cost + 3 + 3 * cut, edits + "R", k + 1, t, (*out, (named, text))))
                own = 1 if role[:1] == "s" and q == 0 else t if role[:1] == named[0] else None
                if own:
                    heapq.heappush(todo, (cost + 3 * cut, edits + "K", k + 1, own, (*out, (role, text))))


def told(rows):
    """What the contract says of the rows (turn, role, text) of one conversation, in order."""
    seen, marked, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, edits, left = cheapest(marked)
    return (gaps, *counts.values(), illegal, cost, edits), "\n".join(f"{r}:{t}" for r, t in left)


def repaired(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "c", "k") for r in rows], TURNS)
    found = repair.audit(df, **sizes)
    turns = repair.repaired(df, found.edits)
    report = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in found.report.collect()}
    texts = {}
    for r in turns.orderBy("conv", "place").collect():
        texts.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    hashes = {r.conv: r.repaired_sha256 for r in repair.digests(turns).collect()}
    assert hashes == {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in texts.items()}
    return {k: (v, "\n".join(texts.get(k, []))) for k, v in report.items()}


def talk(r, n, turn=None):
    roles, texts = ("system", "user", "assistant", "tool", "u", ""), ("Yes.", "no", "", " \n", "Why?", "well", "A b!")
    out = [(r.randrange(-3, n) if turn is None else k, r.choice(roles[: r.choice((3, 6))]), r.choice(texts) + r.choice(("", f" {r.random()}."))) for k in range(n)]
    return out


def test_auction_equals_brute_force():
    r = random.Random(5)
    for _ in range(400):
        rows = "".join(r.choice("suaxSUAXuaua--") for _ in range(r.randrange(0, 9)))
        roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": "user"}
        want = cheapest([(roles[c.lower()], "", c == "-", c.isupper()) for c in rows])
        cost, edits, _ = repair.solved(rows, repair.ENDS, (repair.START,))[0]
        assert (cost, edits) == want[:2]


def test_prices_keep_their_condition():
    r = random.Random(6)
    for _ in range(60):
        rows = "".join(r.choice("suaxUA-") for _ in range(r.randrange(0, 12)))
        arcs, end = repair._lattice(rows, repair.ENDS), 4 * (len(rows) + 1)
        price = repair.auction(arcs, (0,), end)
        assert all(price[i] <= cost + price[j] for i, out in enumerate(arcs) for _, cost, j in out if price[i] < repair.FAR and price[j] < repair.FAR)
        assert price[0] == repair.solved(rows, repair.ENDS, (0,))[0][0]


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 2, "fan_bits": 1}, {"block_rows": 3, "fan_bits": 2}])
def test_repair_equals_brute_force(spark, sizes):
    r = random.Random(7)
    talks = {c: talk(r, r.choice((1, 2, 5, 9, 20)), turn=1) for c in range(25)} | {100: talk(r, 90, turn=1), None: talk(r, 7, turn=1)}
    talks[101] = [(3, "user", "Same."), (3, "user", "Same."), (4, "assistant", "Same."), (9, "user", "Same.")]
    talks[102] = [(k, "user" if k % 2 else "assistant", "Ok.") for k in range(40)]
    rows = [(c, *t) for c, ts in talks.items() for t in ts]
    r.shuffle(rows)
    got = repaired(spark, rows, **sizes)
    assert got == {"" if c is None else f"={c}": told(ts) for c, ts in talks.items()}


def test_repair_nulls_and_empty_tables(spark):
    got = repaired(spark, [(1, None, None, "Hi."), (1, None, "user", None), (1, 2, "assistant", "Yes."), (2, None, "user", "A."), (3, 5, "user", "")])
    assert got["=1"][0][:5] == (0, 1, 0, 0, got["=1"][0][4]) and got["=1"][0][5:] == (7, "DRK" if got["=1"][0][6][0] == "D" else "RDK")
    assert got["=2"] == ((0, 0, 0, 0, 0, 3, "KI"), "user:A.\nassistant:") and got["=3"] == ((0, 1, 0, 0, 0, 4, "D"), "")
    assert repaired(spark, []) == {}


# 12 ranked search

SEPARATORS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in SEPARATORS.findall(text or "")]


def ranked(docs, items, k):
    of = [split(t) for _, t in docs]
    n, total = sum(map(bool, of)), sum(map(len, of))
    df = {}
    for ws in of:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    out, terms = {}, {}
    for i, t in items:
        terms.setdefault(i, set()).update(split(t))
    for i, ts in terms.items():
        rows = []
        for (d, _), ws in zip(docs, of, strict=True):
            m = 50 + 50 * len(ws) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * ws.count(w) // (1000 * ws.count(w) + 20 * m)) for w in ts if w in ws)
            if score:
                rows.append((-score, d is None, d or 0))
        out |= {(i, p + 1): (None if u else d, -s) for p, (s, u, d) in enumerate(sorted(rows)[:k])}
    return out


@pytest.mark.parametrize("term_bytes", [1 << 20, 40])
def test_search_equals_brute_force(spark, term_bytes):
    r = random.Random(8)
    words = [f"w{k}" for k in range(30)] + ["É", "é", "中文", "W1", "a_b", "x-y", "é", "🙂"]
    text = lambda n: r.choice((" ", "\n", "/", "")).join(r.choice(words) for _ in range(n))
    docs = [(k, text(r.randrange(40))) for k in range(80)] + [(None, "w1 w2"), (90, None), (91, ""), (92, "--"), (93, "w1 " * 30_000 + "中文"), (5, "w3"), (94, "W3"), (95, "w3")]
    items = [(k, text(6)) for k in range(8)] + [(20, None), (21, "?"), (22, "absent"), (1, "w9 w9"), (None, "w4 é")]
    got = ranking.search(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, term string"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int"), 7, term_bytes)
    assert {(x.item_id, x.rank): (x.doc_id, x.score) for x in got.collect()} == ranked(docs, items, 7)


def test_search_of_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    for d, i in (([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])):
        assert ranking.search(spark.createDataFrame(d, docs), spark.createDataFrame(i, items)).collect() == []


# 13 chat formatting

ODD = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "[\\\\/INST]", "[INST", "<</s>", "a\\", "\n", "", None, "é🙂</s", "[/INST]\n<s>", "x" * 9000 + "</s>"]


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_chats_come_back(spark, part_bytes):
    r = random.Random(9)
    rows = [(c, k, r.choice(("user", "assistant", "system", "to\nol\\n", "<s>", "", None)), r.choice(ODD)) for c in [*range(12), None] for k in range(r.randrange(1, 12))]
    rows += [(50, k, "assistant", f"{k}.") for k in range(300)] + [(51, None, "assistant", "first"), (51, 0, "user", "then")]
    given = {}
    for c, _, role, text in rows:
        given.setdefault(c, []).append((role or "", text or ""))
    r.shuffle(rows)
    parts = chat.format_chats(spark.createDataFrame([(*x, "c", "k") for x in rows], TURNS.replace("conv string", "part string")), part_bytes)
    got, learned = {}, {}
    for p in sorted(parts.collect(), key=lambda p: p.part):
        back = list(chat.turns(p.formatted))
        assert len(back) == p.n_turns
        got.setdefault(p.conv_id, []).extend(back)
        learned.setdefault(p.conv_id, []).extend(chat.unescape(p.formatted[a:b]) for a, b in zip(p.loss_begin, p.loss_end, strict=True))
    assert got == given
    assert learned == {c: [t for role, t in ts if role == "assistant"] for c, ts in given.items()}
    for x in chat.read_back(parts).collect():
        ts = given[x.conv_id]
        loss = "".join(t for role, t in ts if role == "assistant")
        assert (x.n_turns, x.loss_chars) == (len(ts), len(loss)) and x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert x.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in ts).encode()).hexdigest()


def test_no_chats(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], TURNS))).collect() == []
