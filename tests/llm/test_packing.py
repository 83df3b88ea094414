"""Packing: pieces against the library, places against their rules, the reduction against optimal packings of small instances."""

from __future__ import annotations

import collections
import functools
import random
import zlib

import numpy as np
import pytest

from tallyspark.llm import packing, queries

SCHEMA = "doc_id long, text string, length long, part int, nth long, ids string, sequence_id long, offset long"


def optimum(sizes, capacity):
    """The fewest bins, by search over what the fullest remaining item can be packed with."""

    @functools.cache
    def best(rest):
        if not rest:
            return 0
        w, others = rest[-1], rest[:-1]
        found = len(rest)

        def grow(k, room, left, some):
            nonlocal found
            found = min(found, 1 + best(left))
            for j in range(k, len(some)):
                if some[j] <= room and (j == k or some[j] != some[j - 1]):
                    at = left.index(some[j])
                    grow(j + 1, room - some[j], left[:at] + left[at + 1 :], some)

        grow(0, capacity - w, others, others)
        return found

    return best(tuple(sorted(sizes)))


def expanded(plan):
    """The sequences of a plan as lists of (offset, length), and the ordinals used of each length."""
    bins, used = collections.defaultdict(list), collections.defaultdict(list)
    for w, start, n, each, first, offset in plan.runs:
        used[w] += range(start, start + n)
        for k in range(n):
            bins[first + k // each].append((offset + k % each * w, w))
    return bins, used


def check(plan, counts, capacity):
    bins, used = expanded(plan)
    assert {w: sorted(u) for w, u in used.items()} == {w: list(range(n)) for w, n in counts.items() if n}
    assert set(bins) == set(range(plan.sequences))
    for places in bins.values():
        at = 0
        for o, w in sorted(places):
            assert o == at
            at += w
        assert at <= capacity


def test_reduction_keeps_the_optimum():
    r = random.Random(5)
    fixed = 0
    for _ in range(250):
        capacity = r.choice([10, 17, 30])
        low = r.choice([1, capacity // 5, capacity // 4])
        sizes = [r.randrange(max(1, low), capacity + 1) for _ in range(r.randrange(1, 10))]
        counts = dict(collections.Counter(sizes))
        plan = packing.Plan(counts, capacity)
        packing.reduce(plan)
        rest = [w for w, n in plan.left.items() for _ in range(n)]
        fixed += len(sizes) - len(rest)
        assert plan.sequences + optimum(rest, capacity) == optimum(sizes, capacity)
        packing.best_fit(plan)
        check(plan, counts, capacity)
    assert fixed > 500


def test_each_dominance():
    beside = lambda counts, w, capacity=100: packing._dominating(packing.Plan(counts, capacity), w)
    assert beside({95: 1, 6: 3}, 95) == []
    assert beside({70: 1, 30: 2, 10: 9}, 70) == [30]  # fills the sequence
    assert beside({60: 1, 25: 1, 35: 1}, 60) == [35]  # one more at most
    assert beside({60: 1, 39: 1, 19: 2, 20: 1}, 60) == [39]  # a pair of 39 in all fits in its place
    assert beside({40: 1, 41: 1, 19: 1, 18: 1}, 40) == [41, 19]
    assert beside({10: 30}, 10) is None
    assert beside({50: 2}, 50) == [50]
    assert beside({50: 1}, 50) == []


def test_best_fit_as_one_by_one():
    """Groups give the sequences of plain best fit decreasing, piece by piece."""
    r = random.Random(6)
    for _ in range(60):
        capacity = r.choice([50, 200])
        counts = {w: r.randrange(1, 30) for w in r.sample(range(1, capacity + 1), 12)}
        plan = packing.Plan(counts, capacity)
        packing.best_fit(plan)
        check(plan, counts, capacity)
        rooms = []
        for w in sorted(counts, reverse=True):
            for _ in range(counts[w]):
                fits = [k for k in range(len(rooms)) if rooms[k] >= w]
                if fits:
                    k = min(fits, key=lambda j: rooms[j])
                    rooms[k] -= w
                else:
                    rooms.append(capacity - w)
        assert plan.sequences == len(rooms)


def test_plan_does_not_grow_with_the_rows():
    r = random.Random(7)
    counts = {w: r.randrange(1, 10**9) for w in range(1, 4097)}
    plan = packing.solve(counts)
    assert len(plan.runs) < 150_000 and sum(n for _, _, n, *_ in plan.runs) == sum(counts.values())
    assert plan.sequences <= 1.01 * sum(w * n for w, n in counts.items()) / 4096 + sum(n for w, n in counts.items() if w > 2048) * 0.01
    with pytest.raises(ValueError):
        packing.solve({5000: 1})


def texts():
    from test_operators import prose

    odd = [None, "", " ", "\n\t\r\x0b\x0c\x85 ", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ İstanbul ﬁ Å Å", "it's they'LL 12345 ¿?!", "é ́x", "x" * 30_000, prose(1, 9000), "a b c\x1cd", "한국어 中文 😀👩‍👩‍👧", "word\r\nword"]
    return odd + [prose(k, 30 + 40 * k) for k in range(20)] + [prose(3, 150)] * 30


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    rows = [(k, t, 1, 2, 3, "i", 4, 5) for k, t in enumerate(texts())] + [(None, "null id", *[None] * 6), (3, texts()[20], *[None] * 6), (3, texts()[20], *[None] * 6)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for capacity in (4096, 256):
        want = collections.Counter()
        for r in rows:
            ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
            for k in range(0, len(ids), capacity):
                want[r[0], k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())] += 1
        got = packing.pack_digests(docs, queries.vocabulary("word_bpe_49k.json"), capacity).collect()
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        bins = collections.defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for places in bins.values():
            at = 0
            for o, w in sorted(places):
                assert o == at
                at += w
            assert at <= capacity


def test_words_as_the_library(monkeypatch):
    """Random texts of odd characters, one codec for all of them: marks, capitals, closing marks, added tokens, odd white space."""
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        codec = packing.Words(f.read(), remembered=3000)
    r = random.Random(12)
    parts = ["word", "Word", "WORD", "J\u030c", "j\u030c", "H\u0331", "A\u030a", "\u212a", "ß", "Σ", "ΑΣ", "İ", "I\u0307", "'s", "'S", "'re", "it's", "\u2019s", ".", ",", "...", "?!", '"', "(", ")", "<", "=", "\u0338", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "1", "23", "²", "٣", "ª", "中", "한", "ᄒ", "ᅡ", "😀", "\u200d", "\u00a0", "\u0085", "\u2028", "\x0b", "\x0c", "\x1c", "\x00", "\n", "\t", "\r", " ", " ", " ", " "]
    for round_ in range(40):
        codec.PART = (20, 1 << 20)[round_ % 2]  # long texts are cut before blanks
        texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 40))) for _ in range(50)]
        ids, counts = codec.encode(texts)
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == want, next((t, a, b) for t, a, b in zip(texts, got, want) if a != b)


def test_sequences_hold_the_tokens(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "doc_id long, text string").repartition(3)
    packed = packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), 512)
    rows = {(r.doc_id, r.piece): bytes(r.ids) for r in packed.collect()}
    n = 0
    for s in packing.sequences(packed).collect():
        assert bytes(s.ids) == b"".join(rows[d.doc_id, d.piece] for d in s.docs) and len(s.ids) == 4 * s.length <= 4 * 512
        n += len(s.docs)
    assert n == len(rows)


def test_nothing(spark):
    assert packing.pack_digests(spark.createDataFrame([], SCHEMA), queries.vocabulary("word_bpe_49k.json")).count() == 0
