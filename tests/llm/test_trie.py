"""The prefix trie against a plain one built in memory."""

import hashlib
import random
import re
import zlib

from assayer.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - c % 20, [])[:h] + ts[h:])
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = kids.get(path, [])
        leaves[path] = sum(leaves[p] for p in below) if below else 1
        words = len(WORD.findall(path[-1][1])) if path else 0
        saved[path] = (len(members[path]) - 1) * words + sum(saved[p] for p in below)
    out = []
    for path, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(path))))
        out.append(
            (
                min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(kids.get(path, [])),
                leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def got(table):
    return sorted((tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(table).collect()), key=repr)


def talk(rng, convs, most, texts):
    rows = []
    for c in convs:
        for t in range(rng.randint(0, most)):
            role, text = rng.choice(["user", "assistant", None]), rng.choice(texts)
            rows.append((c, rng.choice([t, t, t, None]), role, text))
    rng.shuffle(rows)
    return rows


def test_small_tables(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "a b  c", "é\x85 x\ty", "w" * 5000]
    rows = [(None, 1, "user", "lost"), (7, 1, "user", "same"), (7, 1, "user", "same"), (10**12, 0, "user", "a")]
    for convs, most in ((range(30), 3), (range(1000, 1200, 3), 5), ([2000, 2020, 2021, 2040, 2041, 2042], 40)):
        rows += talk(rng, convs, most, texts)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_conversations_left_without_turns(spark):
    rows = [(c, 0, "user", "x") for c in range(100, 140) if c % 20]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert any(c[1] == 0 and c[3] > 1 and c[7] != hashlib.sha256(b"").hexdigest() for c in brute(rows))


def test_extra_columns_with_clashing_names(spark):
    rows = talk(random.Random(5), range(25), 4, ["a", "b c"])
    names = "depth k1 k2 place part at block owned total len h a1 b1 w1 ids piece level rows".split()
    table = spark.createDataFrame([(*r, *range(len(names))) for r in rows], SCHEMA + "".join(f", {n} long" for n in names))
    assert got(table) == brute(rows)


def test_long_and_common_conversations(spark, monkeypatch):
    """Pieces, blocks, heavy conversations and heavy parents, with small bounds."""
    monkeypatch.setattr(trie, "PIECE", 16)
    monkeypatch.setattr(trie, "HEAVY", 20)
    monkeypatch.setattr(trie, "TEXT", 40)
    rng = random.Random(6)
    line = [rng.choice("abc") * rng.randint(1, 3) for _ in range(300)]
    rows = [(c, t, "user", line[t]) for c in (0, 3, 40, 45) for t in range(rng.choice([130, 300]))]
    rows += [(c, t, "user", x) for c in range(1000, 1150) for t, x in enumerate(["hello", "hello", "bye", "end of it"])]
    rows += [(c, t, "user", f"{c} says") for c in range(2000, 2100) for t in range(3)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute(rows)


def test_given_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert got(table) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
