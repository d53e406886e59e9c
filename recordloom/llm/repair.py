"""Repair of the turn structure of conversations at least cost, by depth-first branch and bound."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import worker_memory

#: Fixed: what an edit costs, and what a truncated turn adds that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Fixed: the role that may come next at the start, after ``s``, after ``u`` and after ``a``, and the place after it.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {START: ("u", AFTER_U), AFTER_S: ("u", AFTER_U), AFTER_U: ("a", AFTER_A), AFTER_A: ("u", AFTER_U)}
ENDS = (START, AFTER_A)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\v\f\r"
#: A turn's code: which of these its role starts with, or none; more if it must go, or is truncated.
INITIALS = "uas"
MUST_GO, IS_TRUNCATED = 4, 8
#: Results that a worker remembers, of conversations up to so many turns.
REMEMBERED, REMEMBERED_TURNS = 1 << 16, 64
NEVER = 1 << 40


def lower_bounds(codes: bytes) -> list[list[int]]:
    """For every suffix of the turns and every place in the pattern, what its repair costs at least."""
    after = [0, INSERT * 2, INSERT, 0]
    table = [after]
    for code in reversed(codes):
        kind, stays = code & 3, code & MUST_GO == 0
        more = TRUNCATED if code & IS_TRUNCATED else 0
        now = []
        for place in range(4):
            role, then = NEXT[place]
            best = DELETE + after[place]
            if stays:
                best = min(best, REROLE + more + after[then])
                if INITIALS[kind: kind + 1] == role:
                    best = min(best, KEEP + more + after[then])
                if kind == 2 and place == START:
                    best = min(best, KEEP + more + after[AFTER_S])
            now.append(best)
        for place in (AFTER_U, AFTER_A, START, AFTER_S, AFTER_U, AFTER_A):  # a turn may be put in before the next one
            now[place] = min(now[place], INSERT + now[NEXT[place][1]])
        table.append(now)
        after = now
    table.reverse()
    return table


def edits(codes: bytes, at: int, place: int) -> Iterator[tuple[str, int, int, int]]:
    """``(initial, cost, next turn, next place)`` of what can be done next."""
    role, then = NEXT[place]
    if at < len(codes):
        code = codes[at]
        kind, more = code & 3, TRUNCATED if code & IS_TRUNCATED else 0
        yield "D", DELETE, at + 1, place
        if not code & MUST_GO:
            if INITIALS[kind: kind + 1] == role:
                yield "K", KEEP + more, at + 1, then
            elif kind == 2 and place == START:
                yield "K", KEEP + more, at + 1, AFTER_S
            yield "R", REROLE + more, at + 1, then
    yield "I", INSERT, at, then


def _audit(node) -> str:
    letters = []
    while node:
        node, letter = node[0], node[1]
        letters.append(letter)
    return "".join(reversed(letters[:-1]))


def search(codes: bytes) -> tuple[int, str]:
    """The least ``(cost, audit)`` of turns that are given by their codes.

    Edits are tried depth first from an explicit stack, the one with the lowest bound on top,
    ties by its initial. A prefix goes no further if its bound is beyond the incumbent, or equal
    to it with an audit that sorts behind; or if the table of its node, the turn and place it
    has come to, holds a cheaper prefix or an equal one that sorts before. At equal cost, two prefixes
    of one node differ before either ends, so the better one is better with every suffix. When the stack is empty,
    the incumbent is proved best.
    """
    bounds = lower_bounds(codes)
    best_cost, best_path, best_audit = NEVER, [], ""
    tables: dict[tuple[int, int], tuple] = {}
    root = (None, "", 0)
    stack = [(bounds[0][START], 0, START, 0, root)]
    while stack:
        bound, at, place, cost, node = stack.pop()
        if bound > best_cost:
            continue
        if bound == best_cost and node[0]:
            parent = node[0]
            if parent[2] < len(best_path) and best_path[parent[2]] is parent:  # the incumbent came by the same parent
                if node[1] >= best_audit[parent[2]]:
                    continue
            elif _audit(node) >= best_audit[: node[2]]:
                continue
        if at == len(codes) and place in ENDS:
            if cost < best_cost or _audit(node) < best_audit:
                best_cost, best_audit, best_path = cost, _audit(node), []
                while node:
                    best_path.append(node)
                    node = node[0]
                best_path.reverse()
            continue
        seen = tables.get((at, place))
        if seen and (seen[0] < cost or seen[0] == cost and _audit(seen[1]) <= _audit(node)):
            continue
        tables[at, place] = cost, node
        children = [
            (cost + more + bounds[to][then], letter, to, then, cost + more) for letter, more, to, then in edits(codes, at, place)
        ]
        children.sort(reverse=True)
        for low, letter, to, then, spent in children:
            if low <= best_cost:
                stack.append((low, to, then, spent, (node, letter, node[2] + 1)))
    return best_cost, best_audit


def solved(codes: bytes) -> tuple[int, str]:
    if len(codes) > REMEMBERED_TURNS:
        return search(codes)
    memory = worker_memory().setdefault("repairs", {})
    if codes not in memory:
        if len(memory) >= REMEMBERED:
            memory.clear()
        memory[codes] = search(codes)
    return memory[codes]


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation out of the sorted turns, which may span batches."""
    names = ["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kind, state = None, None

    def finish():
        key, codes, blank, duplicate, truncated, illegal, _, first, last, turns = state
        cost, audit = solved(bytes(codes))
        return key, last - first + 1 - turns if turns else 0, blank, duplicate, truncated, illegal, cost, audit

    def batch_of(rows):
        kinds = [kind, *[pa.int64()] * 6, pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        kind, done = batch.schema.field("key").type, []
        columns = [batch.column(c).to_pylist() for c in ("key", "turn", "initial", "fault")]
        for key, turn, initial, fault in zip(*columns):
            if state is None or key != state[0]:
                if state is not None:
                    done.append(finish())
                state = [key, bytearray(), 0, 0, 0, 0, None, None, None, 0]
            code = INITIALS.find(initial) if initial else -1
            code = 3 if code < 0 else code
            if fault:
                state[1 + fault] += 1
                code += MUST_GO if fault < 3 else IS_TRUNCATED
            if state[6] is not None and state[6] + initial not in LEGAL:
                state[5] += 1
            state[6] = initial
            state[1].append(code)
            if turn is not None:
                state[7] = turn if state[7] is None else state[7]
                state[9] += state[8] != turn
                state[8] = turn
        if done:
            yield batch_of(done)
    if state is not None:
        yield batch_of([finish()])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns as repaired; before a conversation's turns comes a row with its audit."""
    names = ["key", "position", "edit", "role", "text"]
    kind, state = None, None  # key, audit, how much of it is done, place, position

    def put(rows, edit, role, text):
        letter = role if role in ("u", "a") else None
        if letter:
            state[3] = NEXT[state[3]][1]
        rows.append((state[0], state[4], edit, ROLES.get(role, role) if letter else role, text))
        state[4] += 1

    def insert(rows):
        while state is not None and state[2] < len(state[1]) and state[1][state[2]] == "I":
            state[2] += 1
            put(rows, "I", NEXT[state[3]][0], "")

    for batch in batches:
        kind, rows = batch.schema.field("key").type, []
        columns = [batch.column(c).to_pylist() for c in ("key", "audit", "role", "text")]
        for key, audit, role, text in zip(*columns):
            if audit is not None:
                state = [key, audit, 0, START, 0]
                insert(rows)
                continue
            edit = state[1][state[2]]
            state[2] += 1
            if edit == "R":
                put(rows, "R", NEXT[state[3]][0], text)
            elif edit == "K":
                state[3] = AFTER_S if state[3] == START and role[:1] == "s" else NEXT[state[3]][1]
                rows.append((state[0], state[4], "K", role, text))
                state[4] += 1
            insert(rows)
        if rows:
            kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _turns(df: DataFrame, key: str, turn: str, role: str, text: str) -> tuple[DataFrame, list[Column]]:
    """Turns under fixed names, nulls as one blank, and their order."""
    filled = lambda c: F.coalesce(df[c].cast("string"), F.lit(" "))
    rows = df.select(df[key].alias("key"), df[turn].cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    rows = rows.withColumn("tie", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return rows, [F.col("turn").asc_nulls_first(), F.col("tie").asc_nulls_first()]


def plan_repairs(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """``key, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation in ``df``.

    Roles should spell ``(s?(ua)+)?`` by their initials. A turn is kept at no cost, given the role user or
    assistant for 1, deleted for 2, and an empty one of these roles is put in anywhere for 5. A turn
    without text, or with role and text seen before, has to go; one whose last character is no
    full stop, question or exclamation mark costs 5 more if it stays. ``audit`` has the edits' initials in
    order, the least of the cheapest repairs.

    Turns go by number, those without one first, ties by a digest of role and text, so repeated rows
    are neighbours and turns of their own. Null role or text is one blank. A null key is a
    conversation of its own; no rows give none. ``gaps`` ignores turns without number. Repeated turns are found
    over partitions by key and digest; the search needs a conversation's turns in one task, as one byte each
    and some 300 bytes for bounds and tables.
    """
    rows, order = _turns(df, key, turn, role, text)
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    seen = F.row_number().over(Window.partitionBy("key", "tie").orderBy(*order)) > 1
    narrow = rows.select("key", "turn", "tie", F.substring("role", 1, 1).alias("initial"), end.alias("end"))
    fault = F.when(F.col("end") == "", 1).when(seen, 2).when(~F.col("end").isin(".", "!", "?"), 3).otherwise(0)
    marked = narrow.withColumn("fault", fault).drop("end")
    kind = df.schema[key].dataType.simpleString()
    sorted_rows = marked.repartition(F.col("key")).sortWithinPartitions("key", *order).select("key", "turn", "initial", "fault")
    counts = ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return sorted_rows.mapInArrow(_examine, f"key {kind}, {counts}, audit string")


def repaired(df: DataFrame, plans: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """``key, position, edit, role, text`` of the repaired turns, after the ``plans`` of the same rows.

    Partitions hold whole conversations in order; texts stream, so a conversation may be longer than memory.
    """
    rows, order = _turns(df, key, turn, role, text)
    kind = df.schema[key].dataType.simpleString()
    none = F.lit(None)
    heads = plans.select(
        "key", F.lit(False).alias("is_turn"), none.cast("long").alias("turn"), none.cast("string").alias("tie"),
        "audit", none.cast("string").alias("role"), none.cast("string").alias("text"),
    )
    turns = rows.select("key", F.lit(True).alias("is_turn"), "turn", "tie", none.cast("string").alias("audit"), "role", "text")
    ordered = heads.unionByName(turns).repartition(F.col("key")).sortWithinPartitions("key", "is_turn", *order)
    return ordered.select("key", "audit", "role", "text").mapInArrow(_apply, f"key {kind}, position long, edit string, role string, text string")
