"""The trie of conversations against one made turn by turn."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import trie
from shelfmark.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth string, conv int, high string, turn_no int"


def rebuilt_plainly(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(xs)] for c, xs in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain(sequences):
    """{conv: [(role, text), ...]} -> result rows of the query."""
    members = {}
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        stack, leaves, saved = [p], 0, 0
        while stack:
            q = stack.pop()
            kids = children.get(q, [])
            leaves += not kids
            saved += (len(members[q]) - 1) * (len(q[-1][1]) if q else 0)
            stack += kids
        return leaves, saved
    out = []
    for p, ms in members.items():
        leaves, saved = below(p)
        ends = ",".join(map(str, sorted(c for c in ms if len(sequences[c]) == len(p))))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(children.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, folder):
    table = spark.createDataFrame([(*r, "d", 7, "h", 1) for r in rows], SCHEMA)
    table.repartition(4).write.parquet(f"{folder}/conversations.parquet")
    return sorted((tuple(r) for r in QUERIES["op13_conversation_trie"](spark, str(folder)).collect()), key=str)


def test_odd_conversations(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for c in [*range(0, 60), *range(100, 130), -1, -100, -150, 10**12, 10**12 + 7, 777]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é😀", ""]) + str(t)))
    rows += [(500 + i, t, "user", f"same {t}") for i in range(30) for t in range(8)]              # copies
    rows += [(3, None, None, None), (3, None, "user", "null turn"), (4, 2, "user", "tie"), (4, 2, "user", "tie"), (4, 2, "a", "tie"),
             (None, 1, "user", "no conversation"), (61, 0, "user", None), (62, 0, None, "x" * 100_000), (900, 5, "u", "one"), (901, 9, "a:", "b"), (902, 9, "a", ":b")]
    assert found(spark, rows, tmp_path) == plain(rebuilt_plainly(rows))


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(1, 0, "user", "hi")], [(5, 0, "u", "a"), (5, 1, "u", "b"), (5, 2, "u", "c")]])
def test_few_rows(spark, tmp_path, rows):
    assert found(spark, rows, tmp_path) == plain(rebuilt_plainly(rows))


def test_long_conversations_and_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    rows = [(c, t, "user", f"{t % 3}") for c in (0, 1, 2) for t in range(40 - c)]
    rows += [(200 + i, t, "user", str(t)) for i in range(50) for t in range(7)]
    rows += [(400 + i, 0, "user", "x") for i in range(30)]
    assert found(spark, rows, tmp_path) == plain(rebuilt_plainly(rows))


def test_sequences_and_texts(spark):
    rows = [(1, 1, "u", "a"), (1, 2, "v", "b"), (2, 1, "u", "a"), (3, 1, "u", "a"), (3, 2, "v", "b"), (4, 1, "w", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = trie.numbered_turns(table).withColumnRenamed("place", "depth")
    lengths = turns.groupBy("conv").agg(F.max("depth").alias("length"))
    made = trie.build(turns.join(lengths, "conv"), lengths)
    assert sorted((r.conv, r.depth, r.weight, r.leaf) for r in made.sequences.collect()) == [(1, 2, 2, True), (2, 1, 1, False), (4, 1, 1, True)]
    assert sorted((r.depth, r.chunk, r.ids) for r in made.ends.collect()) == [(1, 0, [2]), (1, 0, [4]), (2, 0, [1, 3])]
    said = {(r.conv, r.depth): (r.role, r.text, r.n_convs) for r in trie.last_turns(made.nodes, table).collect()}
    assert said == {(1, 0): (None, None, 4), (1, 1): ("u", "a", 3), (1, 2): ("v", "b", 2), (4, 1): ("w", "", 1)}
