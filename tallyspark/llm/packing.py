"""Packing of tokenised documents into sequences: Martello-Toth dominance reduction, then best fit.

A document's tokens are its ids and an end id; only a document longer than the capacity is cut, into pieces of the
capacity. What matters of a piece is its length, so the instance is a histogram with one count for each length: it has no more
entries than the capacity has tokens, whatever the number of documents, and that is all that reaches the driver.

`reduce` fixes sets that provably dominate every other way to pack their largest member, as often as their members
last. `best_fit` packs what is left, the longest first, each into the fullest sequence that has room. Both write runs: so many
pieces of one length, from this ordinal on, so many in a sequence, into sequences from this number on, at this offset.
Bins of one history are handled as one, and each run at least halves the room of the bins it goes to, so there are at most
about 12 runs for each of some 3 groups a length: a few megabytes at most, which go with the job.

Pieces find their place by their ordinal among all pieces of their length: the task that tokenised them numbers its own, and the
counts of the tasks before it are added. No key gathers its rows.

Null texts are empty and have the end id alone. Repeated rows, equal texts and ids, and rows with a null id are packed each for itself;
equal pieces are interchangeable. An empty table gives an empty result. Columns beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _kernel as K
from ._shared import stored
from .bpe import REMEMBERED_CHARS, Codec

CAPACITY = 4096
END = 1
BATCH_TOKENS = 1 << 20


class Words(Codec):
    """Ids by the tokenizers library. The vocabulary's words never hold white space, so a text is the sum of what
    lies between blanks, tabs and line ends; each such chunk is encoded by the library once and remembered up to a fixed number of characters.

    What can't change an id is evened out before, so that fewer chunks differ: the vocabulary ignores case, and a letter and the closing marks behind it
    are words of their own. Case stays where it means something: beside added tokens, and where a combining mark makes
    one character of a small letter but not of the capital."""

    CLOSING = re.compile(r"(?<=[a-zß-öø-ÿ])([.,;:!?]+)(?=[ \n\t\r]|\Z)")
    MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
    TOGETHER = 500
    PART = 1 << 20  # characters of a long text whose chunks are made at once
    BLANK = re.compile(r"[ \n\t\r]")

    def __init__(self, content: str, remembered: int = 2 * REMEMBERED_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.limit = Tokenizer.from_str(content), remembered
        self.library.no_truncation()
        self.library.no_padding()
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]] = True
        self.forget()

    def pieces(self, text: str) -> list[str]:
        if "<|" not in text and (text.isascii() or not self.MARKS.search(text)):
            text = self.CLOSING.sub(r" \1", text.encode().lower().decode())  # of bytes: ASCII letters only
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")  # an empty chunk has no ids

    def parts(self, text: str):
        """A long text in parts that end before a blank, so that its chunks aren't all held as strings."""
        at = 0
        while len(text) - at > self.PART:
            end = self.BLANK.search(text, at + self.PART)
            if end is None:
                break
            yield text[at : end.start()]
            at = end.start()
        yield text[at:] if at else text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, of = [], []
        for k, text in enumerate(texts):
            for part in self.parts(text):
                parts.append(part)
                of.append(k)
        ids, counts = super().encode(parts)
        return ids, np.bincount(of, counts, len(texts)).astype(np.int64)

    def encoded(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)] if chunks else []

    def learn(self) -> None:
        if not self.fresh:
            return
        fresh = self.fresh
        size, at = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        found, total = [self.ids], len(self.ids)
        # letters alone are one word each, and a word's last token says so: many are encoded as one text
        letters = np.fromiter(map(str.isalpha, fresh), bool, len(fresh))
        plain, rest = np.flatnonzero(letters), np.flatnonzero(~letters).tolist()
        groups = [plain[k : k + self.TOGETHER] for k in range(0, len(plain), self.TOGETHER)]
        for group, ids in zip(groups, self.encoded([" ".join([fresh[k] for k in g]) for g in groups])):
            ids = np.array(ids, np.int64)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(group) and cut[-1] == len(ids):
                size[group] = np.diff(cut, prepend=0)
                at[group] = total + cut - size[group]
                found.append(ids)
                total += len(ids)
            else:
                rest += group.tolist()
        each = self.encoded([fresh[k] for k in rest])
        if rest:
            size[rest] = list(map(len, each))
            at[rest] = total + np.cumsum(size[rest]) - size[rest]
            found.append(np.fromiter(itertools.chain.from_iterable(each), np.int64, int(size[rest].sum())))
        self.at, self.size, self.ids = np.append(self.at, at), np.append(self.size, size), np.concatenate(found)
        self.chars += sum(map(len, fresh))
        fresh.clear()


_held: dict[str, Words] = {}  # of this worker process: its next task goes on with the words met so far


def _words(name: str, content) -> Words:
    if name not in _held:
        _held.clear()
        _held[name] = Words(content.value)
    return _held[name]


def _cut(name: str, content, capacity: int, end: int):
    def run(batches):
        codec = _words(name, content)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in K.slices(batch.column(1), 1 << 20):
                rows = batch.slice(some.first, len(some))
                ids, counts = codec.encode([t or "" for t in rows.column(1).to_pylist()])
                ids = np.insert(ids, np.cumsum(counts), end).astype("<u4")
                n = -(-(counts + 1) // capacity)  # pieces of each document
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(capacity, (counts + 1)[row] - piece * capacity)
                order = np.argsort(length, kind="stable")
                runs = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
                nth += seen[length]
                seen += runs
                ends, lo = np.cumsum(length), 0
                while lo < len(row):
                    at = int(ends[lo] - length[lo])
                    hi = max(lo + 1, int(np.searchsorted(ends, at + BATCH_TOKENS, "right")))
                    offsets = np.append(0, (ends[lo:hi] - at) * 4).astype(np.int32)
                    blob = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(ids[at : ends[hi - 1]].tobytes())])
                    cols = [rows.column(0).take(pa.array(row[lo:hi])), pa.array(piece[lo:hi].astype(np.int32)), pa.array(piece[lo:hi] * capacity), pa.array(length[lo:hi]), blob, pa.array(np.full(hi - lo, part, np.int32)), pa.array(nth[lo:hi])]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids", "part", "nth"])
                    lo = hi

    return run


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, nth) of each row of `docs` (doc_id, text). ids: little-endian unsigned
    32-bit integers; part and nth: the task, and the ordinal among its pieces of this length. They hold for one run: store the rows before they are placed."""
    with open(vocabulary, encoding="utf-8") as f:
        said = f.read()
    content = docs.sparkSession.sparkContext.broadcast(said)  # executors need not have the file
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(K.tidy(_cut(hashlib.sha256(said.encode()).hexdigest(), content, capacity, end)), f"doc_id {kind}, piece int, start long, length long, ids binary, part int, nth long")


class Plan:
    """What is left of each length, and the runs so far: (length, first ordinal, pieces, pieces a sequence, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        if any(not 0 < w <= capacity for w in counts):
            raise ValueError("a piece is empty or longer than a sequence")
        self.capacity, self.left = capacity, {w: n for w, n in counts.items() if n > 0}
        self.used, self.sequences, self.runs = dict.fromkeys(self.left, 0), 0, []

    def put(self, w: int, n: int, each: int, first: int, offset: int) -> None:
        self.runs.append((w, self.used[w], n, each, first, offset))
        self.used[w] += n
        self.left[w] -= n

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n


def _dominating(plan: Plan, w: int) -> list[int] | None:
    """Lengths beside one w that dominate all its other company, or None where that can't be shown.

    Of two sets with w one dominates if the other's members can be parted into groups that fit in places of its own members. Let k be how many
    of the shortest others fit beside w. k = 0: alone. Else let s be the longest other that fits. s fills the sequence, or k = 1: {w, s}, as any
    company fits in the place of s. k = 2, and a >= b the two others with the greatest sum that fit: if s >= a + b, every
    pair fits in the place of s; if a = s and no two others that are both longer than b fit, then of any pair the
    longer one fits in the place of a and the shorter one in that of b: {w, a, b}. Taking pieces away makes all of these
    conditions hold the more, so a set can be taken as often as its members last."""
    rest = dict(plan.left)
    rest[w] -= 1
    sizes = np.array(sorted(x for x, n in rest.items() if n > 0), np.int64)
    room = plan.capacity - w
    if not len(sizes) or sizes[0] > room:
        return []
    shortest = [x for x in sizes[:3].tolist() for _ in range(min(3, rest[x]))][:3]
    k = sum(int(sum(shortest[: j + 1]) <= room) for j in range(len(shortest)))
    s = int(sizes[np.searchsorted(sizes, room, "right") - 1])
    if k == 1 or s == room:
        return [s]
    if k > 2:
        return None
    at = np.minimum(np.searchsorted(sizes, room - sizes, "right") - 1, np.arange(len(sizes)))  # the longest partner that isn't longer itself
    single = np.array([rest[x] < 2 for x in sizes.tolist()])
    at = at - ((at == np.arange(len(sizes))) & single)
    sums = np.where(at >= 0, sizes + sizes[np.maximum(at, 0)], -1)
    best = int(np.argmax(sums))
    # of pairs with the same sum, the one with the longest member
    best = int(np.flatnonzero(sums == sums[best])[-1])
    a, b = int(sizes[best]), int(sizes[at[best]])
    if s >= a + b:
        return [s]
    if a != s:
        return None
    longer = sizes[sizes > b].tolist()[:2]
    two = [x for x in longer for _ in range(min(2, rest[x]))][:2]
    return [a, b] if len(two) < 2 or sum(two) > room else None


def reduce(plan: Plan) -> None:
    """Fixes dominating sets, from the longest pieces down, until a pass over all lengths finds none."""
    found = True
    while found:
        found = False
        for w in sorted(plan.left, reverse=True):
            while plan.left[w] > 0:
                beside = _dominating(plan, w)
                if beside is None:
                    break
                found, members = True, [w, *beside]
                n = min(plan.left[x] // members.count(x) for x in members)
                first, offset = plan.open(n), 0
                for x in dict.fromkeys(members):
                    each = members.count(x)
                    plan.put(x, n * each, each, first, offset)
                    offset += x * each
        plan.left = {w: n for w, n in plan.left.items() if n}


def best_fit(plan: Plan) -> None:
    """The rest, the longest first, each into the open sequence with the least room that is enough, or a new one."""
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, sequences)
    rooms: list[int] = []

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                bisect.insort(rooms, room)
            groups.setdefault(room, []).append((first, n))

    for w in sorted(plan.left, reverse=True):
        while plan.left[w]:
            at = bisect.bisect_left(rooms, w)
            if at == len(rooms):
                room, n = plan.capacity, -(-plan.left[w] // (plan.capacity // w))
                first = plan.open(n)
            else:
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            each = room // w
            full = min(n, plan.left[w] // each)
            if full:
                plan.put(w, full * each, each, first, plan.capacity - room)
                keep(room - each * w, first, full)
            if full < n:
                some = plan.left[w]  # fewer than a sequence takes
                if some:
                    plan.put(w, some, some, first + full, plan.capacity - room)
                    keep(room - some * w, first + full, 1)
                keep(room, first + full + bool(some), n - full - bool(some))


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The runs that pack counts[w] pieces of each length w."""
    plan = Plan(counts, capacity)
    reduce(plan)
    best_fit(plan)
    return plan


def placed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`rows` of `pieces`, stored, with sequence_id (from 0) and offset, without part and nth."""
    counts = stored(rows.groupBy("length", "part").agg(F.count("*").alias("n")))
    plan = solve({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    key = runs[:, 0] << 48 | runs[:, 1]  # lengths below 2**15, ordinals below 2**48

    def place(length: pd.Series, ordinal: pd.Series) -> pd.DataFrame:
        size, nth = length.to_numpy(), ordinal.to_numpy()
        at = np.searchsorted(key, size << 48 | nth, "right") - 1
        past, each = nth - runs[at, 1], runs[at, 3]
        return pd.DataFrame({"sequence_id": runs[at, 4] + past // each, "offset": runs[at, 5] + past % each * size})

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")  # a row a task
    numbers = counts.select("length", "part", before.alias("__before"))
    at = F.pandas_udf(place, "sequence_id long, offset long")(F.col("length"), F.col("__before") + F.col("nth"))
    return rows.join(numbers, ["length", "part"]).withColumn("__at", at).select(*[c for c in rows.columns if c not in ("part", "nth")], "__at.sequence_id", "__at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, docs) of placed pieces with ids: the tokens of each sequence in order, and where each piece lies. A sequence has at most the capacity."""
    part = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "piece", "start", "length")))
    joined = F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    places = F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
    return packed.groupBy("sequence_id").agg(part.alias("parts"), F.sum("length").alias("length")).select("sequence_id", "length", joined.alias("ids"), places.alias("docs"))


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): every piece with its tokens and its place."""
    return placed(stored(pieces(docs, vocabulary, capacity, end)), capacity)


def pack_digests(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The same with ids_crc32 in the place of ids: the stored rows stay small."""
    rows = pieces(docs, vocabulary, capacity, end).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return placed(stored(rows), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
