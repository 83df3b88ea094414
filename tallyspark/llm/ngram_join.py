"""Exact n-gram Jaccard self-join by T-occurrence search (DivideSkip), up to connected components.

1. Every text becomes its set of distinct word shingles (64-bit hashes) and a 128-bit
   signature of that set; texts with equal sets are one class from there on.
2. Documents that share fewer than t of their shingles with the rest of the corpus are done: sorted,
   packed shingles go to buckets by value, and buckets count what each document has met. One
   document of each other class goes on. Shingles get one global order there, rare ones first, by the
   number of slices (a third of a million shingles of neighbouring documents) that hold them; slices send
   theirs to buckets and get back which others have, so nothing that grows is broadcast.
3. Two sets with Jaccard >= t share a shingle among the first n - ceil(t n) + 1 of each.
   Inverted lists over these prefixes link classes into candidate blocks, by one hub a list and
   never by pairs. Lists are built within a task first, then across tasks.
4. Blocks are cut into chunks of bounded size. In a chunk, T-occurrence search finds the links:
   short lists are heap-merged, the long ones are binary-probed (DivideSkip).
   Classes that are already connected are not compared again, so that a block of m near copies takes
   a few queries and not m*m comparisons.
5. Chunks of one block exchange queries: hubs first, then everything outside the block's main
   component goes to the chunks that hold a shingle of its prefix. After this every pair of classes that
   can be similar is either connected or was compared: no link between different texts is lost.

Rows with a null id keep their count and get a null component. Null, empty and blank texts have no
shingles and no links; their component is their own id. Rows that share an id are one vertex; repeated rows stay as many rows.
An empty table gives an empty one. A very long text is one sorted array of hashes, never cut. Columns beside doc_id and text don't matter,
whatever their names (`drop_near_copies` carries them along).
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._shared import checkpointed, components, partitions, stored

TOKEN_BITS = 40  # of a shingle, for candidates only: an accidental match there costs a comparison, never a result
SLICE_TOKENS = 300_000
MOST_SLICE_TOKENS = 4_000_000  # where there are very many buckets a slice is larger, so that it has something for each
BUCKET_TOKENS = 1_000_000
FEW = 1_000_000  # ids that may be broadcast (8 MB); more are joined by a shuffle
CHUNK_DOCS = 256
CHUNK_TOKENS = 2_000_000
HUBS = 8
MOST_PARTITIONS = 2000  # of a shuffle by buckets, unless the session asks for more


def jaccard_need(a: int | np.ndarray, b: int | np.ndarray, num: int, den: int):
    """The overlap from which den * intersection >= num * union holds."""
    return -(-num * (a + b) // (num + den))


def text_sets(texts: K.Texts, size: int) -> list[np.ndarray]:
    starts, ends, of = texts.words()
    hashes, of, _ = K.shingles(texts.hashes(starts, ends, lower=True), of, len(texts), size)
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    for lo, hi in zip(cut[:-1], cut[1:]):
        s = np.sort(hashes[lo:hi])
        out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) else s)
    return out


class Lists:
    """Inverted lists of a chunk's sets, with DivideSkip search."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(self.n), self.sizes)
        order = np.argsort(token, kind="stable")
        token, self.owner = token[order], owner[order]
        new = np.append(True, token[1:] != token[:-1]) if len(token) else np.zeros(0, bool)
        self.start = np.flatnonzero(new)
        self.token = token[self.start]
        self.length = np.diff(np.append(self.start, len(token)))
        self.key = (np.cumsum(new) - 1) * self.n + self.owner  # of list and member, ascending

    def search(self, s: np.ndarray, num: int, den: int) -> np.ndarray:
        """Members whose sets are similar to s; s itself too if it is one."""
        if not len(s) or not len(self.token):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.token, s)
        at = at[(at < len(self.token)) & (self.token[np.minimum(at, len(self.token) - 1)] == s)]
        need = -(-num * len(s) // den)  # the least overlap with any admissible size
        if len(at) < need:
            return np.zeros(0, np.int64)
        at = at[np.argsort(self.length[at], kind="stable")]
        long = min(need - 1, int(need / (0.0085 * math.log2(max(2, int(self.length[at[-1]]))) + 1)))
        short, far = at[: len(at) - long], at[len(at) - long :]
        runs = [self.owner[a : a + n].tolist() for a, n in zip(self.start[short], self.length[short])]
        found, counts = [], []
        for member in heapq.merge(*runs):  # equal members come one after the other
            if found and found[-1] == member:
                counts[-1] += 1
            else:
                found.append(member)
                counts.append(1)
        ids, count = np.array(found, np.int64), np.array(counts, np.int64)
        lo, hi = -(-num * len(s) // den), den * len(s) // num
        fit = (count >= need - len(far)) & (self.sizes[ids] >= lo) & (self.sizes[ids] <= hi) if len(ids) else np.zeros(0, bool)
        ids, count = ids[fit], count[fit]
        least = jaccard_need(self.sizes[ids], len(s), num, den)
        for part in np.array_split(far, max(1, len(far) * len(ids) // 1_000_000)):
            if not len(part) or not len(ids):
                continue
            probe = part[:, None] * self.n + ids[None, :]
            where = np.searchsorted(self.key, probe)
            hit = self.key[np.minimum(where, len(self.key) - 1)] == probe
            count = count + hit.sum(0)
        return ids[count >= least]


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def chunk_links(sets: list[np.ndarray], num: int, den: int) -> Union:
    """Components of a chunk. Afterwards every pair in different components was compared: first, queries by
    members nobody has reached yet; then by all members outside the largest component that asked nothing so far."""
    lists, union = Lists(sets), Union(len(sets))
    asked = [False] * len(sets)
    reached = [False] * len(sets)

    def ask(k: int) -> None:
        asked[k] = True
        for j in lists.search(sets[k], num, den).tolist():
            reached[j] = True
            union.join(k, j)

    for k in range(len(sets)):
        if not reached[k]:
            ask(k)
    roots = [union.find(k) for k in range(len(sets))]
    main = max(set(roots), key=roots.count) if roots else -1
    for k in range(len(sets)):
        if not asked[k] and roots[k] != main:
            ask(k)
    return union


# ---- features ---------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Ascending integers as differences of as few bytes as the largest needs."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    rows = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, blob[0])
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, : blob[0]] = rows
    return np.cumsum(wide.view("<u8")[:, 0], dtype=np.uint64)


SLICE_SCHEMA = "slice long, ids array<long>, counts array<long>, sigs array<long>, sigs2 array<long>, lengths array<long>, tokens binary, blobs array<binary>"


def _facts(size: int):
    """(doc_id, n_shingles, sig, sig2, slack): the size and signature of every document's set; slack: shingles that coincide when cut short."""

    def run(batches):
        for batch in batches:
            for texts in K.slices(batch.column(1)):
                sets = text_sets(texts, size)
                n, slack, one, two = np.zeros((4, len(sets)), np.int64)
                for k, s in enumerate(sets):
                    if len(s):
                        n[k] = len(s)
                        t = s >> np.uint64(64 - TOKEN_BITS)
                        slack[k] = np.count_nonzero(t[1:] == t[:-1])
                        one[k], two[k] = K.signed(np.add.reduce(K.mix(s, 1))[None])[0], K.signed(np.add.reduce(K.mix(s, 2))[None])[0]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), *map(pa.array, (n, one, two, slack))], ["doc_id", "n_shingles", "sig", "sig2", "slack"])

    return run


def _dealt(size: int, buckets: int, slice_tokens: int):
    """The cut shingles of about a third of a million at a time, dealt to buckets by value.

    A shingle of one document of the slice goes with its owner; one of several, once and without them (`known`), as these have met
    already: a row of the slice's own counts says so (`local`). So a bucket gets a shingle once a slice, however many hold it."""
    bounds = np.array([-(-(b << TOKEN_BITS) // buckets) for b in range(1, buckets)], np.uint64)

    def rows(ids, parts, lengths):
        flat = np.concatenate(parts)
        owner = np.repeat(np.arange(len(ids), dtype=np.uint32), lengths)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
        flat, owner = flat[new], owner[new]
        ids = np.asarray(ids, np.int64)
        name = int(ids[0])
        head = np.append(True, flat[1:] != flat[:-1])
        several = np.append(~head[1:], False) | ~head
        known = flat[several & head]
        met = np.bincount(owner[several], minlength=len(ids))
        flat, owner = flat[~several], owner[~several]
        cut, known_cut = (np.concatenate([[0], np.searchsorted(x, bounds), [len(x)]]) for x in (flat, known))
        out = []
        if met.any():
            out.append((name % buckets, name, ids[met > 0].tobytes(), None, None, None, met[met > 0].astype(np.int64).tobytes()))
        for b, (lo, hi, first, last) in enumerate(zip(cut[:-1], cut[1:], known_cut[:-1], known_cut[1:])):
            if hi > lo or last > first:
                used, at = np.unique(owner[lo:hi], return_inverse=True)
                kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
                out.append((b, name, ids[used].tobytes(), pack(flat[lo:hi]), bytes([np.dtype(kind).itemsize]) + at.astype(kind).tobytes(), pack(known[first:last]), None))
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["bucket", "slice", "ids", "tokens", "owners", "known", "local"])

    def run(batches):
        ids, parts, lengths, n = [], [], [], 0
        for batch in batches:
            for texts in K.slices(batch.column(1)):
                starts, ends, of = texts.words()
                hashes, of, _ = K.shingles(texts.hashes(starts, ends, lower=True), of, len(texts), size)
                if not len(hashes):
                    continue
                ids += batch.column(0).slice(texts.first, len(texts)).to_pylist()
                parts.append(hashes >> np.uint64(64 - TOKEN_BITS))
                lengths.append(np.bincount(of, minlength=len(texts)))
                n += len(hashes)
                if n >= slice_tokens:
                    yield rows(ids, parts, np.concatenate(lengths))
                    ids, parts, lengths, n = [], [], [], 0
        if n:
            yield rows(ids, parts, np.concatenate(lengths))

    return run


def _met(batches):
    """(slice, ids, met): for the documents of each slice, how many of their shingles in a bucket any other document has too."""
    for _, rows in K.grouped(batches, 1):
        out, names, tokens, owners, ids, base, known = [], [], [], [], [], [0], []
        for r in zip(*(rows[c].to_pylist() for c in ("slice", "ids", "tokens", "owners", "known", "local"))):
            name, i, t, o, k, met = r
            if met is not None:
                out.append((name, i, met))
                continue
            names.append(name)
            tokens.append(unpack(t))
            owners.append(np.frombuffer(o, np.uint16 if o[0] == 2 else np.uint32, offset=1).astype(np.uint32) + np.uint32(base[-1]))
            ids.append(np.frombuffer(i, np.int64))
            base.append(base[-1] + len(ids[-1]))
            known.append(unpack(k))
        if tokens:
            tokens, owners = np.concatenate(tokens), np.concatenate(owners)
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            same = tokens[1:] == tokens[:-1]
            hit = np.zeros(len(tokens), bool)
            hit[1:] |= same
            hit[:-1] |= same
            known = np.unique(np.concatenate(known))
            if len(known):
                hit |= known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens
            met = np.bincount(owners[order[hit]], minlength=base[-1])
            for name, mine, a in zip(names, ids, base):
                n = met[a : a + len(mine)]
                if n.any():
                    out.append((name, mine[n > 0].tobytes(), n[n > 0].astype(np.int64).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], ["slice", "ids", "met"])


def _summed(batches):
    """(doc_id, met) of each slice, over its buckets."""
    for _, rows in K.grouped(batches, 1):
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in rows["ids"].to_pylist()])
        met = np.concatenate([np.frombuffer(x, np.int64) for x in rows["met"].to_pylist()])
        each, at = np.unique(ids, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(np.bincount(at, met, len(each)).astype(np.int64))], ["doc_id", "met"])


def _slices(size: int, buckets: int, slice_tokens: int):
    """One row for each slice of about a million shingles: its documents' sets, and all of its shingles dealt to buckets by their value."""

    def row(ids, sets):
        one, two = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        shorts = []
        for k, s in enumerate(sets):
            if len(s):
                one[k], two[k] = K.signed(np.add.reduce(K.mix(s, 1))[None])[0], K.signed(np.add.reduce(K.mix(s, 2))[None])[0]
            t = s >> np.uint64(64 - TOKEN_BITS)  # still ascending
            shorts.append(t[np.append(True, t[1:] != t[:-1])] if len(t) else t)
        flat = np.concatenate(shorts) if shorts else np.zeros(0, np.uint64)
        every = np.unique(flat)
        cut = np.searchsorted(every, np.array([-(-(b << TOKEN_BITS) // buckets) for b in range(buckets + 1)], np.uint64))
        tokens = flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (TOKEN_BITS + 7) // 8].tobytes()
        name = int(K.signed(np.add.reduce(K.mix(one.view(np.uint64) ^ K.mix(np.array([i or 0 for i in ids], np.int64).view(np.uint64)), len(ids)))[None])[0])
        counts = [len(s) for s in sets]
        cols = [[name], [ids], [counts], [one.tolist()], [two.tolist()], [[len(t) for t in shorts]], [tokens], [[pack(every[a:b]) for a, b in zip(cut[:-1], cut[1:])]]]
        big = pa.list_(pa.int64())
        kinds = [pa.int64(), big, big, big, big, big, pa.binary(), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["slice", "ids", "counts", "sigs", "sigs2", "lengths", "tokens", "blobs"])

    def run(batches):
        ids, sets, n = [], [], 0
        for batch in batches:
            for texts in K.slices(batch.column(1)):
                for i, s in zip(batch.column(0).slice(texts.first, len(texts)).to_pylist(), text_sets(texts, size)):
                    ids.append(i)
                    sets.append(s)
                    n += len(s) + 1
                    if n >= slice_tokens:
                        yield row(ids, sets)
                        ids, sets, n = [], [], 0
        if ids:
            yield row(ids, sets)

    return run


def _repeated(batches):
    """Of a bucket's blobs (bucket, slice, blob): for every slice, its shingles that any other slice or document has too."""
    for (bucket,), rows in K.grouped(batches, 1):
        parts = [unpack(b.as_py()) for chunk in rows["blob"].chunks for b in chunk]
        both = np.sort(np.concatenate(parts))
        again = np.unique(both[1:][both[1:] == both[:-1]])
        count = np.searchsorted(both, again, "right") - np.searchsorted(both, again, "left")
        for name, part in zip(rows["slice"].to_pylist(), parts):
            at = np.minimum(np.searchsorted(again, part), max(0, len(again) - 1))
            hit = again[at] == part if len(again) else np.zeros(len(part), bool)
            if hit.any():
                freq = count[at[hit]].astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([bucket]), pa.array([pack(part[hit])]), pa.array([freq])], ["slice", "bucket", "shared", "freq"])


def _prefixes(num: int, den: int):
    """(sig, prefix) of every document: of its prefix in the order of (slices that have it, value), the shingles that more than one document has."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                width = (TOKEN_BITS + 7) // 8
                rows = np.frombuffer(r["tokens"], np.uint8).reshape(-1, width)
                wide = np.zeros((len(rows), 8), np.uint8)
                wide[:, :width] = rows
                flat = wide.view("<u8")[:, 0]
                found = sorted(r["found"] or [], key=lambda f: f["bucket"])
                shared = np.concatenate([unpack(f["shared"]) for f in found]) if found else np.zeros(0, np.uint64)
                freq = np.concatenate([np.frombuffer(f["freq"], "<u4") for f in found]).astype(np.int64) if found else np.zeros(0, np.int64)
                shared, first = np.unique(shared, return_index=True)  # slices of repeated rows have one name and get each other's rows too
                freq = freq[first]
                # within the slice, by document: copies of one set count once
                lengths = np.array(r["lengths"], np.int64)
                fresh = np.zeros(len(lengths), bool)
                fresh[np.unique(np.array(r["sigs"], np.int64), return_index=True)[1]] = True
                mine, times = np.unique(flat[np.repeat(fresh, lengths)], return_counts=True)
                times = times.astype(np.int64)
                if len(shared):
                    at = np.minimum(np.searchsorted(shared, mine), len(shared) - 1)
                    rest = np.where(shared[at] == mine, freq[at] - 1, 0)
                else:
                    rest = np.zeros(len(mine), np.int64)
                # one function of the shingle alone, whichever slice asks: slices that hold it or, if one does, documents in it
                rank = np.where(rest > 0, rest + 1, times - 1)
                twice = (times > 1) | (rest > 0)
                where = np.searchsorted(mine, flat)
                cut = np.append(0, np.cumsum(lengths))
                out, sizes, sigs = [], [], []
                for k in np.flatnonzero(fresh & (lengths > 0)):
                    at = where[cut[k] : cut[k + 1]]
                    n = r["counts"][k]
                    take = len(at) - (-(-num * n // den) - (n - len(at))) + 1
                    first = at[np.argsort(rank[at], kind="stable")[:take]]
                    first = first[twice[first]]
                    if len(first):
                        out.append(mine[first])
                        sizes.append(len(first))
                        sigs.append(r["sigs"][k])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(sigs), K.list_array(K.signed(np.concatenate(out)), np.array(sizes))], ["sig", "prefix"])

    return run


def _hubs(tokens: np.ndarray, members: np.ndarray, emit_rest: bool):
    """One row (token, least member) a token; and (member, hub) of all others, reduced to a spanning forest."""
    order = np.lexsort((members, tokens))
    tokens, members = tokens[order], members[order]
    new = np.append(True, tokens[1:] != tokens[:-1])
    hub = members[new][np.cumsum(new) - 1]
    rest = members != hub
    ids, pairs = np.unique(np.concatenate([members[rest], hub[rest]]), return_inverse=True)
    union = Union(len(ids))
    half = int(rest.sum())
    for a, b in set(zip(pairs[:half].tolist(), pairs[half:].tolist())):
        union.join(a, b)
    up = np.array([union.find(k) for k in range(len(ids))], np.int64)
    moved = up != np.arange(len(ids))
    return tokens[new], members[new], ids[moved], ids[up[moved]] if len(ids) else ids


def _lists(last: bool):
    """Of a task's prefixes: kind 0, (token, hub), kind 1, (class, hub). last: kind 1 only, of rows (token, class)."""

    def out(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    def run(batches):
        held, n = [], 0

        def flush():
            token, member, a, b = _hubs(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), last)
            if not last:
                yield out(0, token, member)
            yield out(1, a, b)

        for batch in batches:
            if last:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            else:
                lists = batch.column(1)
                lengths = lists.value_lengths().to_numpy()
                held.append((lists.flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), lengths)))
            n += len(held[-1][0])
            if n >= CHUNK_TOKENS and not last:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return run


# ---- blocks -----------------------------------------------------------------------------------


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for texts in K.slices(batch.column(1)):
                sets = text_sets(texts, size)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                part = batch.slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), K.list_array(K.signed(flat), np.array([len(s) for s in sets]))], ["node", "block", "chunk", "items"])

    return run


def _items(column) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy().view(np.uint64)
    cut = np.append(0, np.cumsum(column.value_lengths().to_numpy()))
    return [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _local(num: int, den: int):
    """(block, chunk, node, component) of each chunk."""

    def run(batches):
        for (block, chunk), rows in K.grouped(batches, 2):
            nodes, sets = rows["node"].to_numpy(), _items(rows["items"])
            order = np.lexsort((nodes, [len(s) for s in sets]))
            nodes, sets = nodes[order], [sets[k] for k in order]
            union = chunk_links(sets, num, den)
            least: dict[int, int] = {}
            roots = [union.find(k) for k in range(len(sets))]
            for r, v in zip(roots, nodes.tolist()):
                least[r] = min(v, least.get(r, v))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), block)), pa.array(np.full(len(nodes), chunk, np.int64)), pa.array(nodes), pa.array(np.array([least[r] for r in roots], np.int64))], ["block", "chunk", "node", "component"])

    return run


def _cross(num: int, den: int):
    """Links (a, b) of the queries that were sent to a chunk; one for each component reached."""

    def run(batches):
        for _, rows in K.grouped(batches, 2):
            nodes, comps, role, sets = rows["node"].to_numpy(), rows["component"].to_numpy(), rows["role"].to_numpy(), _items(rows["items"])
            mine = np.flatnonzero(role == 0)
            lists = Lists([sets[k] for k in mine])
            for q in np.flatnonzero(role == 1):
                hit = mine[lists.search(sets[q], num, den)]
                reach = np.unique(comps[hit])
                if len(reach):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(reach), comps[q])), pa.array(reach)], ["a", "b"])

    return run


def _across(sets: DataFrame, local: DataFrame, prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """Labels (node, component) after the chunks of each block have exchanged queries; prefixes: (node, prefix)."""
    spark = sets.sparkSession
    schema = "block long, chunk long, role int, node long, component long, items array<long>"
    many = local.groupBy("block").agg(F.max("chunk").alias("last")).filter("last > 0")
    label = checkpointed(local.join(many, "block").select("block", "chunk", "node", "component"))
    full = stored(sets.join(many.select("block"), "block", "left_semi"))
    # where each shingle of a prefix is: similar sets share one, so a query has to see the chunks of its own only
    listed = stored(label.select("block", "chunk", "node").join(prefixes, "node").select("block", "chunk", "node", F.explode("prefix").alias("token")))
    for stage in ("hubs", "rest"):
        rows = full.join(label, ["block", "chunk", "node"]).select("block", "chunk", "node", "component", "items")
        if stage == "hubs":
            # some members of every chunk's largest component, to chunk 0
            sizes = label.groupBy("block", "chunk", "component").agg(F.count("*").alias("n"))
            main = sizes.groupBy("block", "chunk").agg(F.max_by("component", F.struct("n", "component")).alias("component"))
            hubs = label.filter("chunk > 0").join(main, ["block", "chunk", "component"]).withColumn("h", F.xxhash64("node"))
            picked = hubs.groupBy("block", "chunk", F.pmod("h", F.lit(HUBS)).alias("k")).agg(F.min_by("node", F.struct("h", "node")).alias("node"))
            ask = rows.join(picked.select("block", "chunk", "node"), ["block", "chunk", "node"], "left_semi").withColumn("chunk", F.lit(0).cast("long"))
        else:
            sizes = label.groupBy("block", "component").agg(F.count("*").alias("n"))
            main = sizes.groupBy("block").agg(F.max_by("component", F.struct("n", "component")).alias("component"))
            outside = checkpointed(label.join(main, ["block", "component"], "left_anti").select("block", "chunk", "node"))
            places = listed.select("block", "token", F.col("chunk").alias("to")).distinct()
            sent = listed.join(outside, ["block", "chunk", "node"], "left_semi").join(places, ["block", "token"]).filter("to <> chunk").select("block", "chunk", "node", "to").distinct()
            ask = rows.join(sent, ["block", "chunk", "node"]).withColumn("chunk", F.col("to")).drop("to")
        pick = lambda df, role: df.select("block", "chunk", F.lit(role).alias("role"), "node", "component", "items")
        # chunks that nobody asks need not come
        asked = checkpointed(pick(ask, 1))
        both = pick(rows, 0).join(asked.select("block", "chunk").distinct(), ["block", "chunk"], "left_semi").union(asked)
        links = both.repartition(partitions(spark), "block", "chunk").sortWithinPartitions("block", "chunk").mapInArrow(K.tidy(_cross(num, den)), "a long, b long")
        moved = components(links)
        label = checkpointed(label.join(moved.withColumnRenamed("component", "to"), label.component == moved.node, "left").select("block", "chunk", label.node, F.coalesce("to", label.component).alias("component")))
    return label.select("node", "component")


def _in_parts(dealt: DataFrame, parts: int) -> DataFrame:
    """Rows of buckets, dealt evenly."""
    return dealt.withColumn("__part", (F.col("bucket") % parts).cast("int")).repartitionById(parts, "__part").drop("__part")


def ngram_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    feats = stored(docs.mapInArrow(K.tidy(_facts(size)), "doc_id long, n_shingles long, sig long, sig2 long, slack long"))
    usable = feats.filter("n_shingles > 0 and doc_id is not null")
    # checkpointed, so that joins with it are plain shuffles, of which a large group of copies can be split
    classes = checkpointed(usable.groupBy("sig", "sig2", "n_shingles", "slack").agg(F.min("doc_id").alias("rep")))

    # only a document that shares its share of shingles with others can be similar to one of them
    buckets = max(16, int(length) // 6 // BUCKET_TOKENS)
    slice_tokens = min(MOST_SLICE_TOKENS, max(SLICE_TOKENS, 64 * buckets))
    parts = min(buckets, max(MOST_PARTITIONS, partitions(spark)))  # more buckets than that share a task, one after the other
    dealt = docs.filter("doc_id is not null").mapInArrow(K.tidy(_dealt(size, buckets, slice_tokens)), "bucket long, slice long, ids binary, tokens binary, owners binary, known binary, local binary")
    met = _in_parts(dealt, parts).sortWithinPartitions("bucket").mapInArrow(K.tidy(_met), "slice long, ids binary, met binary")
    met = met.repartition(partitions(spark), "slice").sortWithinPartitions("slice").mapInArrow(K.tidy(_summed), "doc_id long, met long")
    met = met.groupBy("doc_id").agg(F.sum("met").alias("met"))
    need = F.ceil(F.col("n_shingles") * num / F.lit(den)) - F.col("slack")
    able = classes.join(met, classes.rep == met.doc_id).filter(F.col("met") >= need).select("sig", "sig2", "n_shingles", "rep")
    able = checkpointed(able)
    few = able.count() <= FEW
    ids = able.select(F.col("rep").alias("doc_id")).distinct()
    slices = stored(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(K.tidy(_slices(size, buckets, slice_tokens)), SLICE_SCHEMA))

    dealt = slices.select(F.posexplode("blobs").alias("bucket", "blob"), "slice").filter("length(blob) > 0").select(F.col("bucket").cast("long").alias("bucket"), "slice", "blob")
    shared = _in_parts(dealt, parts).sortWithinPartitions("bucket").mapInArrow(K.tidy(_repeated), "slice long, bucket long, shared binary, freq binary")
    back = shared.groupBy("slice").agg(F.collect_list(F.struct("bucket", "shared", "freq")).alias("found"))
    known = slices.select("slice", "counts", "sigs", "lengths", "tokens").join(back, "slice", "left").select("counts", "sigs", "lengths", "tokens", "found")
    prefixes = stored(known.mapInArrow(K.tidy(_prefixes(num, den)), "sig long, prefix array<long>"))
    lists = prefixes.mapInArrow(K.tidy(_lists(False)), "kind int, a long, b long")
    total = prefixes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = max(partitions(spark), total // 2_000_000)
    across = lists.filter("kind = 0").select("a", "b").repartition(parts, "a").mapInArrow(K.tidy(_lists(True)), "kind int, a long, b long")
    candidate = components(lists.filter("kind = 1").select("a", "b").union(across.select("a", "b")))

    part = able.join(candidate.select(F.col("node").alias("sig"), F.col("component").alias("block")), "sig").select("rep", "block", "n_shingles")
    part = checkpointed(part)
    whole = checkpointed(part.groupBy("block").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("tokens")))
    cuts = F.greatest(F.ceil(F.col("docs") / chunk_docs), F.ceil(F.col("tokens") / CHUNK_TOKENS))
    placed = part.join(F.broadcast(whole) if whole.count() <= FEW else whole, "block").select(F.col("rep").alias("doc_id"), "block", F.pmod(F.xxhash64("rep"), cuts.cast("long")).alias("chunk")).distinct()
    few = placed.count() <= FEW
    rows = docs.join(F.broadcast(placed) if few else placed, "doc_id")
    # repeated rows count once; only those of repeated ids are shuffled for that, after map-side combine
    again = checkpointed(usable.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    n = again.count()
    if n:
        again = F.broadcast(again) if n <= FEW else again
        rows = rows.join(again, "doc_id", "left_anti").union(rows.join(again, "doc_id", "left_semi").distinct())
    sets = stored(rows.mapInArrow(K.tidy(_sets(size)), "node long, block long, chunk long, items array<long>"))
    dealt = sets.select("block", "chunk", "node", "items").repartition(partitions(spark), "block", "chunk").sortWithinPartitions("block", "chunk")
    local = checkpointed(dealt.mapInArrow(K.tidy(_local(num, den)), "block long, chunk long, node long, component long"))

    # rows that share an id are one vertex: it joins the classes of all its texts
    members = usable.join(classes, ["sig", "sig2", "n_shingles", "slack"]).select("doc_id", "rep")
    ids = members.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    joins = local.select(F.col("node").alias("a"), F.col("component").alias("b"))
    more = ids.filter("rep <> other").select("doc_id").join(members, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    cut = bool(local.filter("chunk > 0").limit(1).count())
    if cut:
        mine = able.select("sig", F.col("rep").alias("node")).join(prefixes, "sig").select("node", "prefix")
        joins = joins.union(_across(sets, local, mine, num, den).select(F.col("node").alias("a"), F.col("component").alias("b")))
    if cut or more.limit(1).count():
        label = components(joins.union(more))
    else:
        label = joins.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
    named = ids.join(label, ids.rep == label.node, "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    return feats.join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that stand for their component: those whose id is the smallest in it.

    Rows with a null id stay. Of rows that share an id all or none stay."""
    found = stored(ngram_components(docs, **how).filter("component_id <> doc_id").select("doc_id").distinct())
    few = found.count() <= FEW
    return docs.join(F.broadcast(found) if few else found, "doc_id", "left_anti").select(docs.columns)
