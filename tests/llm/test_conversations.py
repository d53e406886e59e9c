import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recordloom.llm import queries, repair, sequences, trie
from tests.llm.helpers import SF_DIR, write_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = hashlib.sha256(b"").hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_trie(conversations: dict) -> dict:
    """Nodes by path: conversations are lists of (role, text)."""
    members = defaultdict(list)
    for key, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(key)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        own = (len(members[path]) - 1) * len(WORD.findall(path[-1][1])) if path else 0
        saved[path] = own + sum(saved[c] for c in children[path])
    return {
        (min(m), len(p)): (
            min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
            sha(",".join(str(k) for k in sorted(m) if len(conversations[k]) == len(p))),
        )
        for p, m in members.items()
    }


def ordered(rows):
    """Turns of each key, in the order of their numbers."""
    out = defaultdict(list)
    for key, turn, role, text in rows:
        if key is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            out[key].append(((turn is not None, turn or 0, digest), (role, text)))
    return {k: [t for _, t in sorted(v)] for k, v in out.items()}


def brute_spliced(rows):
    turns = ordered(rows)
    out = {}
    for key, own in turns.items():
        h = zlib.crc32(str(key).encode()) % 4
        out[key] = turns.get(key - (key % 20 if key >= 0 else -(-key % 20)), [])[:h] + own[h:]
    return out


def got_trie(df):
    return {(r["low"], r["depth"]): (r["parent"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()}


def conversation_rows(sf_dir=SF_DIR):
    table = pq.read_table(f"{sf_dir}/conversations.parquet").to_pydict()
    return list(zip(*(table[c] for c in ("conv_id", "turn", "role", "text"))))


SCHEMA = "conv_id long, turn long, role string, text string, key string, path string, depth int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def test_op11_equals_brute_force(spark):
    df = queries.QUERIES["op11_conversation_trie"](spark, SF_DIR).withColumnsRenamed({"conv_id": "low", "parent_conv_id": "parent"})
    assert got_trie(df) == brute_trie(brute_spliced(conversation_rows()))
    assert df.count() == len(got_trie(df))


def random_rows(n, seed, alphabet="abc", most=7):
    rng = random.Random(seed)
    rows = []
    for key in range(n):
        for turn in range(rng.randrange(most)):
            rows.append((key, turn, rng.choice("ua"), " ".join(rng.choice(alphabet) for _ in range(rng.choice((0, 1, 1, 2))))))
    return rows


@pytest.mark.parametrize("whole_rows, block_rows", [(40_000, 16), (60, 4)])
def test_trie_over_many_blocks_and_rounds(spark, monkeypatch, whole_rows, block_rows):
    monkeypatch.setattr(trie, "WHOLE_ROWS", whole_rows)
    monkeypatch.setattr(trie, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(trie, "BLOCK_BYTES", 400)
    rows = random_rows(700, 1)
    keys = {r[0] for r in rows}
    found = trie.trie(trie.paths(frame(spark, rows).repartition(13), "conv_id", "turn", "role", "text"))
    want = brute_trie({k: t for k, t in ordered(rows).items() if k in keys})
    assert got_trie(found) == want


def test_trie_of_odd_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x y"), (2, 0, "user", ""), (None, 0, "user", "gone"),
        (3, 5, "", "x y"), (-7, 1, "user", "w " * 50_000), (4, 1, "user", "w " * 50_000), (4, 2, "a", " b\tc"), (-7, 2, "a", " b\tc"),
    ]
    found = trie.trie(trie.paths(frame(spark, rows), "conv_id", "turn", "role", "text"))
    assert got_trie(found) == brute_trie(ordered(rows))


def test_one_deep_conversation_among_copies(spark):
    deep = [(k, t, "user", f"turn {t}") for k in range(300) for t in range(2000 if k in (7, 8) else 3)]
    found = got_trie(trie.trie(trie.paths(frame(spark, deep), "conv_id", "turn", "role", "text")))
    assert found[0, 3][1:4] == (300, 1, 1) and found[0, 3][5] == sha(",".join(str(k) for k in range(300) if k not in (7, 8)))
    assert found[7, 2000] == (7, 2, 0, 1, 2, sha("7,8"))
    assert found[0, 0] == (None, 300, 1, 1, 2 * (299 * 3 + 1997), EMPTY)


def test_conversation_queries_on_empty_tables(spark, tmp_path):
    folder = write_table(tmp_path, "conversations", {"conv_id": pd.array([], "int64"), "turn": pd.array([], "int64"), "role": pd.array([], "str"), "text": pd.array([], "str")})
    for name in ("op11_conversation_trie", "op12_conversation_repair"):
        assert queries.QUERIES[name](spark, folder).collect() == []


def test_spliced_conversations_without_turns_belong_to_the_root(spark):
    # key 21: its head is that of key 20, which does not exist, so only turns after the head are left
    rows = [(k, 0, "user", "hi.") for k in range(21, 40)]
    df = trie.trie(queries.spliced(trie.paths(frame(spark, rows), "conv_id", "turn", "role", "text")))
    assert got_trie(df) == brute_trie(brute_spliced(rows))
    assert any(zlib.crc32(str(k).encode()) % 4 for k in range(21, 40))


def test_digests_of_long_sequences(spark):
    df = spark.range(60_000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("key"), F.col("id").alias("place"), F.col("id").cast("string").alias("piece"))
    found = {r["key"]: r["sha256"] for r in sequences.digest_in_order(df, ",").collect()}
    assert len(found) == 20_001 and found[3] == sha("3")
    assert found[-1] == sha(",".join(str(i) for i in range(60_000) if i % 3))


# --- repair ---


def brute_repair(turns):
    """Cheapest repair of (role, text, fault) by trying everything between two places, without search or bounds."""
    layer = {"": (0, "", ())}  # place in the pattern by what has been spelled last: '', s, u, a

    def better(table, place, entry):
        if place not in table or entry[:2] < table[place][:2]:
            table[place] = entry

    def step(place, letter):
        return letter if (letter == "s" and place == "") or (letter == "u" and place != "u") or (letter == "a" and place == "u") else None

    def with_inserts(table):
        done = {}
        for place, entry in table.items():
            for k in range(4):
                better(done, place, entry)
                letter = "a" if place == "u" else "u"
                place, entry = step(place, letter), (entry[0] + 5, entry[1] + "I", entry[2] + (({"u": "user", "a": "assistant"}[letter], ""),))
        return done

    for role, text, fault in turns:
        layer, before = {}, with_inserts(layer)
        for place, (cost, audit, rows) in before.items():
            better(layer, place, (cost + 2, audit + "D", rows))
            if fault in (1, 2):
                continue
            more = 5 if fault == 3 else 0
            to = step(place, role[:1]) if role[:1] else None
            if to:
                better(layer, to, (cost + more, audit + "K", rows + ((role, text),)))
            for letter, name in (("u", "user"), ("a", "assistant")):
                if step(place, letter):
                    better(layer, letter, (cost + 1 + more, audit + "R", rows + ((name, text),)))
    layer = with_inserts(layer)
    return min(layer[p] for p in ("", "a") if p in layer)


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        words = WORD.findall(text)
        out.append(1 if not words else 2 if (role, text) in seen else 3 if words[-1][-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def brute_conversation(rows):
    """The contract's columns for sorted (turn, role, text)."""
    turns = [(r, t) for _, r, t in rows]
    fault = faults(turns)
    numbers = {n for n, _, _ in rows if n is not None}
    initials = [r[:1] for r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, kept = brute_repair([(r, t, f) for (r, t), f in zip(turns, fault)])
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return gaps, fault.count(1), fault.count(2), fault.count(3), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept))


def brute_damaged(rows):
    out = {}
    for key, turn, role, text in rows:
        own = out.setdefault(key, [])
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)

    def place(row):
        turn, role, text = row
        return turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()

    return {k: brute_conversation(sorted(v, key=place)) for k, v in out.items()}


REPAIR = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got_repair(df):
    return {r["conv_id"]: tuple(r[c] for c in REPAIR) for r in df.collect()}


def test_op12_equals_brute_force(spark):
    df = queries.QUERIES["op12_conversation_repair"](spark, SF_DIR)
    assert got_repair(df) == brute_damaged(conversation_rows())


def test_op12_on_odd_conversations(spark, tmp_path):
    rng = random.Random(3)
    texts = ["a.", "b!", "", " \t\x0b", "no end", "c? \n", None, "a.", "x ", "d." * 30_000]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "umbrella"]
    rows = [(key if key % 9 else None, rng.choice([None, *range(5)]), rng.choice(roles), rng.choice(texts)) for key in range(400) for _ in range(rng.randrange(9))]
    rows += rows[:40] + [(1000, n, rng.choice(roles[:3]), f"{n}.") for n in range(300)]
    folder = write_table(tmp_path, "conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}).assign(key=1, audit="x", copy="z"))
    df = queries.QUERIES["op12_conversation_repair"](spark, folder)
    assert got_repair(df) == brute_damaged(rows) and df.count() == len({r[0] for r in rows})


def every_code():
    return [kind + more for kind in range(4) for more in (0, repair.MUST_GO, repair.IS_TRUNCATED)]


def turns_of(codes):
    names = ["user", "assistant", "system", "tool"]
    return [(names[c & 3], str(i), 2 if c & repair.MUST_GO else 3 if c & repair.IS_TRUNCATED else 0) for i, c in enumerate(codes)]


def test_search_finds_the_least_repair_of_all_short_conversations():
    for n in range(4):
        for codes in itertools.product(every_code(), repeat=n):
            assert repair.search(bytes(codes)) == brute_repair(turns_of(codes))[:2]
    rng = random.Random(5)
    for _ in range(400):
        codes = rng.choices(every_code(), k=rng.randrange(4, 30))
        assert repair.search(bytes(codes)) == brute_repair(turns_of(codes))[:2]


def test_search_does_not_need_tight_bounds(monkeypatch):
    """Incumbent and tables prove the optimum with the plainest bound as well."""
    monkeypatch.setattr(repair, "lower_bounds", lambda codes: [[0] * 4] * (len(codes) + 1))
    rng = random.Random(6)
    for _ in range(300):
        codes = rng.choices(every_code(), k=rng.randrange(8))
        assert repair.search(bytes(codes)) == brute_repair(turns_of(codes))[:2]


def test_search_of_a_very_long_conversation():
    rng = random.Random(7)
    codes = bytes(rng.choices(every_code(), k=50_000))
    cost, audit = repair.search(codes)
    assert sum(c != "I" for c in audit) == len(codes) and cost == repair.lower_bounds(codes)[0][repair.START]
