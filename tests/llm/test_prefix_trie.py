"""The prefix trie against a dictionary of whole prefixes, with long conversations, repeated rows, ties, nulls and hot nodes."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest

from tallyspark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, last boolean, n string"


def plain(rows, family=5, head=9):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    nodes = collections.defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % head
        base = c - (c % family if c >= 0 else -(-c % family))
        path = (*own.get(base, [])[:h], *mine[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append((c, len(path) == d))
    kids = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    first = {p: min(c for c, _ in m) for p, m in nodes.items()}
    ends = lambda m: hashlib.sha256(",".join(map(str, sorted(c for c, e in m if e))).encode()).hexdigest()
    return sorted((first[p], len(p), first[p[:-1]] if p else None, len(m), kids[p], leaves[p], saved[p], ends(m)) for p, m in nodes.items())


def found(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def made(r, n, words=4):
    rows = []
    for c in range(n):
        for t in range(r.choice([0, 1, 2, 5, 12])):
            rows.append((c if r.random() < 0.9 else c - n, r.choice([t, t, t, None, 3]), r.choice(["user", "assistant", None]), r.choice([None, "", "Ünï", *[f"word {k}" for k in range(words)]]), 1, True, "x"))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_whole_prefixes(spark, seed):
    r = random.Random(seed)
    rows = made(r, 80) + [(None, 1, "user", "nobody's", None, None, None)]
    rows += rows[:15] + [rows[3]] * 4  # repeated rows are turns of their own
    rows += [(500 + k, t, "user", f"same {t}", 0, False, "") for k in range(40) for t in range(6)]  # one group of equal conversations
    rows += [(7, 100 + t, "user", "on and on", 0, False, "") for t in range(60)] + [(1005, 0, "u", "x" * 200_000, 0, False, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(prefix_trie.trie(df)) == plain(rows)


def test_cut_conversations_and_blocks(spark, monkeypatch):
    """Long conversations in ranges, repeated rows in blocks, ends in blocks: the same rows."""
    r = random.Random(9)
    rows = made(r, 60, 2) + [(2, 4, "user", "again", 1, True, "")] * 300 + [(12, t, "user", f"t{t % 3}", 1, True, "") for t in range(200)]
    rows += [(600 + k, 0, "user", "hello", 1, True, "") for k in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = plain(rows)
    assert found(prefix_trie.trie(df)) == want
    monkeypatch.setattr(prefix_trie, "COPIES_A_ROW", 7)
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    assert found(prefix_trie.trie(df, long=20)) == want


def test_other_families(spark):
    rows = made(random.Random(11), 50)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie.trie(df, family=3, head=4)) == plain(rows, 3, 4)


def test_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = spark.createDataFrame([(4, 0, "user", "hi", 1, True, "")], SCHEMA)
    assert found(prefix_trie.trie(lone)) == plain([(4, 0, "user", "hi")])
