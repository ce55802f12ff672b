"""Conversation structure repair: the cheapest edits that make the roles take turns, by an auction shortest-path algorithm."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueforge.llm.common import in_order, materialize, slices

#: What an edit costs, and what an undeleted truncated row adds.
DELETE, RENAME, INSERT, CUT = 4, 3, 3, 3
#: Rows of a lattice; longer conversations are several lattices whose costs are carried from one to the next.
BLOCK_ROWS = 64
#: Blocks (and groups of blocks) that one task takes together: 2 to this power.
FAN_BITS = 6

#: States of a conversation so far: nothing, a system row, a user row, an assistant row. It may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
BEFORE_USER = (START, SYSTEM, ASSISTANT)
FAR = 1 << 60
ENDS = (0, FAR, FAR, 0)

Arcs = list[list[tuple[str, int, int]]]


# The lattice of a run of rows. A row is a letter: s, u, a, or x for another role, as a capital if it is truncated, and - if it must go.


def _lattice(rows: str, exits: tuple[int, ...]) -> Arcs:
    """Arcs (edit, cost, node) of each node: node ``4 * k + q`` is state q after k rows, the last node is the end, reached at the cost of ``exits``."""
    arcs: Arcs = []
    end = 4 * (len(rows) + 1)
    for k in range(len(rows) + 1):
        letter = rows[k] if k < len(rows) else None
        kept = letter is not None and letter != "-"
        cut = CUT if kept and letter.isupper() else 0
        for q in STATES:
            out: list[tuple[str, int, int]] = []
            nexts = [USER] if q in BEFORE_USER else [ASSISTANT]
            if letter is not None:
                out.append(("D", DELETE, 4 * (k + 1) + q))
                own = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(letter.lower())
                if kept and (own in nexts or (own == SYSTEM and q == START)):
                    out.append(("K", cut, 4 * (k + 1) + own))
                if kept:
                    out += [("R", RENAME + cut, 4 * (k + 1) + t) for t in nexts]
            elif exits[q] < FAR:
                out.append(("", exits[q], end))
            out += [("I", INSERT, 4 * k + t) for t in nexts]
            arcs.append(out)
    arcs.append([])
    return arcs


def _reaching(arcs: Arcs, to: int) -> set[int]:
    """Nodes from which ``arcs`` lead to the node ``to``."""
    into: list[list[int]] = [[] for _ in arcs]
    for i, out in enumerate(arcs):
        for _, _, j in out:
            into[j].append(i)
    seen, todo = {to}, [to]
    while todo:
        for i in into[todo.pop()]:
            if i not in seen:
                seen.add(i)
                todo.append(i)
    return seen


def auction(arcs: Arcs, origins: tuple[int, ...], end: int) -> list[int]:
    """Node prices that have converged at ``origins``: there the price is the least cost to ``end`` (FAR if there is no way).

    Prices start at 0 and never break ``price[i] <= cost + price[j]``; the path from an origin holds arcs in which they are
    equal. Its last node either raises its price to the best of its arcs and leaves the path (contraction), or, if it has that
    price, hands on to the node of that arc (extension). The costs are whole numbers and every cycle costs something, so a
    price rises by 1 at least and the path has no cycle.
    """
    ways = _reaching(arcs, end)
    price = [0 if i in ways else FAR for i in range(len(arcs))]
    open_arcs = [[(cost, j) for _, cost, j in out if j in ways] for out in arcs]
    for origin in origins:
        path = [origin] if origin in ways else []
        while path and path[-1] != end:
            last = path[-1]
            best, onward = min((cost + price[j], j) for cost, j in open_arcs[last])
            if price[last] < best:
                price[last] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(onward)
    return price


@functools.lru_cache(1 << 15)
def solved(rows: str, exits: tuple[int, ...], entries: tuple[int, ...]) -> tuple[tuple[int, str, int] | None, ...]:
    """(cost, edits, last state) of the cheapest way through ``rows`` from each of ``entries``, the ASCII-least among equals.

    At converged prices every cheapest way consists of tight arcs, and a way of tight arcs to the end is a cheapest one.
    So of the tight arcs that lead on to the end, the least letter is taken at each node; a node has one arc a letter.
    """
    arcs, end = _lattice(rows, exits), 4 * (len(rows) + 1)
    price = auction(arcs, entries, end)
    tight = [[(letter, cost, j) for letter, cost, j in out if price[i] < FAR and price[i] == cost + price[j]] for i, out in enumerate(arcs)]
    ways = _reaching(tight, end)
    out: list[tuple[int, str, int] | None] = []
    for entry in entries:
        node, edits = entry, []
        while node != end and node in ways:
            last = node
            letter, _, node = min(x for x in tight[node] if x[2] in ways)
            edits.append(letter)
        out.append((price[entry], "".join(edits), last % 4) if node == end else None)
    return tuple(out)


@functools.lru_cache(1 << 15)
def _costs(rows: str) -> list[int]:
    """Cost from each state to each state through ``rows``: 16 numbers, FAR where there is no way."""
    table = [auction(_lattice(rows, tuple(0 if q == t else FAR for q in STATES)), STATES, 4 * (len(rows) + 1)) for t in STATES]
    return [table[t][q] for q in STATES for t in STATES]


# What is known of a run of blocks is folded over groups of blocks, and what comes in from outside is spread over them again.


def _cost_before(costs: list[int], after: list[int]) -> list[int]:
    """Cost to the end at the begin of a block, from that at its end."""
    return [min(min(costs[4 * q + t] + after[t] for t in STATES), FAR) for q in STATES]


def _fold_costs(blocks: list[list[int]]) -> list[int]:
    columns = []
    for t in STATES:
        after = [0 if q == t else FAR for q in STATES]
        for b in reversed(blocks):
            after = _cost_before(b, after)
        columns.append(after)
    return [columns[t][q] for q in STATES for t in STATES]


def _spread_costs(blocks: list[list[int]], after: list[int]) -> list[list[int]]:
    out = []
    for b in reversed(blocks):
        out.append(after)
        after = _cost_before(b, after)
    return out[::-1]


def _fold_ways(blocks: list[list[int]]) -> list[int]:
    now = list(STATES)
    for b in blocks:
        now = [b[q] if q >= 0 else q for q in now]
    return now


def _spread_ways(blocks: list[list[int]], entry: list[int]) -> list[list[int]]:
    out = []
    for b in blocks:
        out.append(entry)
        entry = [b[entry[0]]]
    return out


def _mapped(df: DataFrame, fn: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``fn`` makes of each row, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [made for row in batch.to_pylist() for made in fn(row)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema(list(zip(names, kinds, strict=True))))

    parts = [p.split(" ") for p in schema.split(", ")]
    names = [p[0] for p in parts]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}[p[1]] for p in parts]
    return df.mapInArrow(run, schema)


def carried(blocks: DataFrame, fold: Callable, spread: Callable, start: tuple[int, ...], fan_bits: int) -> DataFrame:
    """Rows (conv, part, seq, carry): what reaches each block of a conversation from the others.

    ``blocks(conv, part, seq, known)`` of a conversation are in order of (part, seq). Groups of 2^fan_bits neighbours are folded to one until
    a conversation is one; ``start`` goes in there, and is spread over the groups level by level. No task sees more than a group.
    """
    high = blocks.agg(F.coalesce(F.max("seq"), F.lit(0)), F.coalesce(F.max("part"), F.lit(0))).first()
    steps = [c for c, most in zip(("seq", "part"), high, strict=True) for _ in range(-(-int(most).bit_length() // fan_bits))]
    levels, now = [], blocks
    for column in steps:
        kid = F.struct("part", "seq", "known")
        group = now.groupBy("conv", *[F.shiftright(c, fan_bits).alias(f"up_{c}") if c == column else F.col(c).alias(f"up_{c}") for c in ("part", "seq")])
        level = materialize(group.agg(F.array_sort(F.collect_list(kid)).alias("kids")).select("conv", F.col("up_part").alias("part"), F.col("up_seq").alias("seq"), "kids"), "carry")
        levels.append(level)
        now = _mapped(level, lambda r: [(r["conv"], r["part"], r["seq"], fold([k["known"] for k in r["kids"]]))], "conv string, part long, seq long, known array<bigint>")
    carry = now.select("conv", "part", "seq", F.array(*[F.lit(x).cast("long") for x in start]).alias("carry"))
    for level in reversed(levels):

        def down(r: dict) -> Iterator[tuple]:
            kids = r["kids"]
            for kid, x in zip(kids, spread([k["known"] for k in kids], r["carry"]), strict=True):
                yield r["conv"], kid["part"], kid["seq"], x

        carry = _mapped(level.join(carry, ["conv", "part", "seq"]), down, "conv string, part long, seq long, carry array<bigint>")
    return carry


# Faults and blocks.


def conversation_key(conv_id: str = "conv_id") -> Column:
    """A string for each conv_id, null included."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def _turn_key() -> Column:
    """Equal for equal role and text: 128 bits of a SHA-256."""
    return F.substring(F.sha2(F.concat_ws(":", F.length("role").cast("string"), F.col("role"), F.col("text")).cast("binary"), 256), 1, 32)


def _initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def _rows(rows: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text, key); a null role or text is a blank."""
    x = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return x.select(conversation_key().alias("conv"), "*", _turn_key().alias("key"))


_BLOCKS = "conv string, part long, seq long, rows string, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, head array<string>, tail array<string>"


def _block_rows(lines: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of up to ``block_rows`` rows of a conversation, numbered by task and place in it, with their counts of faults.

    ``lines`` are in order. ``head`` and ``tail`` (initial, turn) are those of a conversation's first and last block in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        done: list[dict] = []
        block: dict | None = None
        before: tuple | None = None  # initial and turn of the row before, of the same conversation

        def opened(conv: str, seq: int) -> dict:
            return dict(conv=conv, part=part, seq=seq, rows="", blank=0, duplicate=0, truncated=0, illegal=0, turns=0, low=None, high=None, head=None, tail=None)

        def edge(row: tuple) -> list:
            return [row[0], None if row[1] is None else str(row[1])]

        def put(conv: str, turn: int | None, initial: str, fault: str) -> None:
            nonlocal block, before
            if block is None or block["conv"] != conv:
                if block is not None:
                    done.append(block | {"tail": edge(before)})
                block, before = opened(conv, 0), None
            elif len(block["rows"]) == block_rows:
                done.append(block)
                block = opened(conv, block["seq"] + 1)
            if before is None:
                block["head"] = edge((initial, turn))
            elif before[0] + initial not in ("su", "ua", "au"):
                block["illegal"] += 1
            if turn is not None and (before is None or before[1] != turn):
                block["turns"] += 1
                block["low"] = turn if block["low"] is None else block["low"]
                block["high"] = turn
            if fault:
                block[fault] += 1
            block["rows"] += "-" if fault in ("blank", "duplicate") else initial.upper() if fault == "truncated" else initial
            before = initial, turn

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=made)

        text = pa.list_(pa.string())
        made = pa.schema([(n, pa.string() if n in ("conv", "rows") else text if n in ("head", "tail") else pa.int64()) for n in [p.split(" ")[0] for p in _BLOCKS.split(", ")]])
        for batch in batches:
            for conv, turn, copies, is_first, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "copies", "is_first", "initial", "fault")), strict=True):
                for k in range(copies):
                    put(conv, turn, initial, fault if fault == "blank" or (k == 0 and is_first) else "duplicate")
                    if len(done) >= 1024:
                        yield batch_of(done)
                        done.clear()
        if block is not None:
            done.append(block | {"tail": edge(before)})
        yield batch_of(done)

    return lines.mapInArrow(run, _BLOCKS)


@dataclass
class Audit:
    """``report``: a row a conversation with its faults, cost and edits. ``edits``: (conv, audit), as ``apply_edits`` reads them."""

    report: DataFrame
    edits: DataFrame


def audit(rows: DataFrame, block_rows: int = BLOCK_ROWS, fan_bits: int = FAN_BITS) -> Audit:
    """Faults of each conversation of ``rows(conv_id, turn, role, text)`` and its cheapest edits.

    Rows of a conversation are in order of turn, nulls first (ties by a hash of role and text, equal rows together). A row's
    first fault counts: blank, duplicate (role and text seen earlier), truncated (no ``[.!?]`` at its end). Edits are Keep (0), Rerole
    to user or assistant (3), Delete (4; a must for blank and duplicate rows) and Insert an empty user or assistant row (3); an undeleted truncated
    row adds 3. The initials of what is left read ``(s?(ua)+)?``; of equally cheap edits the ASCII-least initials win.

    Repeated rows are counted before anything is dealt by key, the earliest of equal texts is the least of its group, and
    rows are dealt by ranges of (conversation, turn): a conversation of any size is spread over tasks. Its blocks meet only as 16
    costs each, in groups of 2^fan_bits. A null conv_id is a conversation, a null role or text one blank; an empty table
    gives no row; other columns are not read.
    """
    e = _rows(rows)
    solid = r"[^\x20\x09-\x0D]"
    ending = F.regexp_extract("text", rf"(?s)({solid})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(solid), "blank").when(~ending.isin(".", "!", "?"), "truncated").otherwise("")
    copies = e.groupBy("conv", "turn", "key").agg(F.count("*").alias("copies"), F.first(_initial()).alias("initial"), F.first(fault).alias("fault"))
    # The first turn of each text: nulls come first, as in the conversation.
    least = copies.groupBy("conv", "key").agg(F.min(F.struct(F.col("turn").isNotNull().alias("told"), "turn")).alias("at")).select("conv", F.col("at.turn").alias("turn"), "key", F.lit(0).cast("long").alias("copies"), F.lit(None).cast("string").alias("initial"), F.lit(None).cast("string").alias("fault"))
    both = copies.unionByName(least).groupBy("conv", "turn", "key").agg(F.sum("copies").alias("copies"), (F.count("*") > 1).alias("is_first"), F.max("initial").alias("initial"), F.max("fault").alias("fault"))
    blocks = materialize(_block_rows(in_order(both, "conv", "turn", "key"), block_rows), "blocks")

    many = blocks.groupBy("conv").agg(F.count("*").alias("n"))
    single = blocks.join(many.where("n = 1"), "conv").select("conv", "part", "seq", "rows")
    several = materialize(blocks.join(many.where("n > 1"), "conv").select("conv", "part", "seq", "rows"), "blocks-of-long")
    plans = _mapped(single, lambda r: [(r["conv"], r["part"], r["seq"], *solved(r["rows"], ENDS, (START,))[0][:2])], _PLAN).unionByName(_long_plans(several, fan_bits))

    # A block's cost counts to the end of the conversation: the whole cost is that of the first block, the greatest.
    edits = plans.groupBy("conv").agg(F.max("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    edits = materialize(edits, "edits")
    # Where a conversation goes from one task to the next, the two rows there are still to be compared.
    edge = F.when(F.col("head").isNotNull() | F.col("tail").isNotNull(), F.struct("part", "seq", "head", "tail"))
    counts = blocks.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")], F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.collect_list(edge)).alias("edges"))
    of = lambda c: F.filter(F.transform("edges", lambda x: x[c]), lambda x: x.isNotNull())
    counts = counts.withColumns({"heads": of("head"), "tails": of("tail")})
    counts = counts.withColumn("joints", F.expr("if(size(heads) > 1, zip_with(slice(tails, 1, size(heads) - 1), slice(heads, 2, size(heads) - 1), (a, b) -> struct(a, b)), array())"))
    apart = F.size(F.filter("joints", lambda x: ~F.concat(x["a"][0], x["b"][0]).isin("su", "ua", "au")))
    same = F.size(F.filter("joints", lambda x: x["a"][1] == x["b"][1]))
    told = counts.select("conv", F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("turns") - same), F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + apart).alias("illegal"))
    return Audit(told.join(edits, "conv"), edits.select("conv", "audit"))


_PLAN = "conv string, part long, seq long, cost long, audit string"


def _long_plans(blocks: DataFrame, fan_bits: int) -> DataFrame:
    """Edits of each block of conversations of several blocks; the whole cost stands at the first block."""
    key = ["conv", "part", "seq"]
    costs = _mapped(blocks, lambda r: [(r["conv"], r["part"], r["seq"], _costs(r["rows"]))], "conv string, part long, seq long, known array<bigint>")
    after = carried(costs, _fold_costs, _spread_costs, ENDS, fan_bits)

    def ways(r: dict) -> Iterator[tuple]:
        made = solved(r["rows"], tuple(r["carry"]), STATES)
        yield r["conv"], r["part"], r["seq"], [x[2] if x else -1 for x in made], [x[0] if x else FAR for x in made], [x[1] if x else "" for x in made]

    through = materialize(_mapped(blocks.join(after, key), ways, "conv string, part long, seq long, known array<bigint>, cost array<bigint>, audit array<string>"), "ways")
    entry = carried(through.select(*key, "known"), _fold_ways, _spread_ways, (START,), fan_bits)
    q = F.col("carry")[0].cast("int")
    return through.join(entry, key).select(*key, F.get("cost", q).alias("cost"), F.get("audit", q).alias("audit"))


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows (conv, place, role, text) of the repaired conversations, in order within each task; a conversation is in one task.

    The rows stream through the task beside their conversation's edits. Of a conversation whose rows all go there is no row.
    """
    text = _rows(rows).select("conv", F.lit(1).alias("kind"), "turn", "key", "role", "text", F.lit("").alias("audit"))
    plan = edits.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("key"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, letters, at, place, last = None, "", 0, 0, ""

        def put(role: str, text: str) -> None:
            nonlocal place, last
            out.append((conv, place, role, text))
            place, last = place + 1, role[:1]

        def turn_of() -> str:
            return "assistant" if last == "u" else "user"

        def inserts() -> None:
            nonlocal at
            while at < len(letters) and letters[at] == "I":
                put(turn_of(), "")
                at += 1

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 4, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv", "place", "role", "text"])
            out.clear()
            return made

        for batch in batches:
            for part in slices(batch):
                for of, kind, role, text, audit in zip(*(part.column(c).to_pylist() for c in ("conv", "kind", "role", "text", "audit")), strict=True):
                    if kind == 0:
                        inserts()
                        conv, letters, at, place, last = of, audit, 0, 0, ""
                        continue
                    inserts()
                    if letters[at] != "D":
                        put(role if letters[at] == "K" else turn_of(), text)
                    at += 1
                yield batch_of()
        inserts()
        yield batch_of()

    x = text.unionByName(plan).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "key")
    return x.select("conv", "kind", "role", "text", "audit").mapInArrow(run, "conv string, place long, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """Rows (conv, repaired_sha256) of ``repaired`` rows: the hash of ``role:text`` by line, as they stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = None, None, []
        for batch in batches:
            for of, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "place", "role", "text")), strict=True):
                if of != conv:
                    if conv is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = of, hashlib.sha256()
                state.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())
            yield batch_of(done)
            done = []
        yield batch_of([(conv, state.hexdigest())] if conv is not None else [])

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["conv", "repaired_sha256"])

    return turns.mapInArrow(run, "conv string, repaired_sha256 string")
