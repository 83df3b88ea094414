"""Line deduplication by pairwise alignment: rare line hashes bring documents together, patience diff aligns them.

1. Seeds of a document are runs of its worded lines: each line and each two neighbours of `seed_words` words or more,
   the shortest runs of `passage_words` words or more from each line on and up to each line, and the whole text.
   The k-th occurrence of a line (or of two neighbours) is a seed of its own.
2. Every seed that several documents hold takes its later holders to the earliest one: as many meetings as seeds, however
   many hold one.
3. Two documents overlap if they meet through a rare seed, one that at most `rare_holders` documents hold; a document has as many
   partners as its rare seeds have earliest holders. The whole line sequences of both are then aligned by patience diff: equal heads and tails, then
   lines that come once in both, of which the longest run in the same order stays, then the same between these anchors; where no line comes
   once in both, equal lines are paired by their occurrence. Runs of aligned lines that follow one another in both texts are
   common blocks. A block that holds one of the rare seeds goes from the later document with all of its lines, common ones too. Lines in another order stay.
4. A block without a rare seed stays: a byline that a third of all documents hold isn't deleted for another block of the same two
   documents. The exact way of frequent lines is by length: a run of lines with `passage_words` words or more that an earlier
   document holds too is a common block in itself, wherever it stands and however many hold it, and goes. The runs of step 1
   cover all lines of every such block. A text that is equal to an earlier one goes whole, from `seed_words` words on.

Of two partners the shorter's lines travel to the longer, whose own come once, however many partners it has.

"Later" is by (doc_id, hash of the text): null ids take no part and stay as they are; rows with the same id
and text are one document, and stay alike. Null and empty texts have no lines; an empty table gives an empty one. Extra columns
are carried along, but those named as the new ones are replaced. Lines are split at \\n only and compared
byte by byte, by 64-bit hashes. The cost is linear in lines: a very long text has more of them and no other treatment.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._shared import checkpointed, partitions, stored, unused

FEW = 1_000_000
#: kind 0: lines and neighbours, 1: passages and whole texts, which go wherever they stand
SEED = "h long, doc_id long, mark long, place int, size int, kind int, n_lines int"
LINES = "doc_id long, mark long, lines array<long>"
FOUND = "doc_id long, mark long, first int, last int, partner long"


def worded_lines(texts: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, and number of words of every line with a word."""
    starts, ends, _ = texts.words()
    first, last, of = K.spans(texts.data != 10, texts.offsets)
    count = np.searchsorted(starts, last) - np.searchsorted(starts, first)
    keep = count > 0
    first, last, of, count = first[keep], last[keep], of[keep], count[keep]
    return texts.hashes(first, last), of, count


def numbered(key: np.ndarray) -> np.ndarray:
    """For every key, how often it came before."""
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])[: len(key)]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.arange(len(key)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else 0
    return rank


def runs(h: np.ndarray, of: np.ndarray, words: np.ndarray, seed_words: int, passage_words: int):
    """The seeds of consecutive texts, given their worded lines: (first line, size, kind, hash)."""
    n = len(h)
    line = np.arange(n)
    begin, end = np.searchsorted(of, of, "left"), np.searchsorted(of, of, "right")
    before = np.append(0, np.cumsum(words))
    one, two = K.mix(h, 1), K.mix(h, 2)
    total = [np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64)) for x in (one, two, two * np.arange(1, n + 1, dtype=np.uint64))]

    def hashed(a, b, salt):
        """Of the lines a to b - 1, by sums of their hashes and of their hashes times their places in the run."""
        plain, mixed, placed = (t[b] - t[a] for t in total)
        return K.mix((plain ^ K.mix(placed - mixed * a.astype(np.uint64), 4)) + (b - a).astype(np.uint64), salt)

    out = []
    neighbours = line[:-1][of[1:] == of[:-1]] if n else line
    for a, size in ((line, 1), (neighbours, 2)):
        a = a[before[a + size] - before[a] >= seed_words]
        key = hashed(a, a + size, 3 + size)
        rank = numbered(key ^ K.mix(of[a].astype(np.uint64), 6))
        key = np.where(rank > 0, K.mix(key + rank.astype(np.uint64), 9), key)
        out.append((a, np.full(len(a), size), np.zeros(len(a), np.int64), key))
    # from each line on, and up to each line where that isn't one of the former; single lines too
    last = np.searchsorted(before, before[:-1] + passage_words)
    last = np.where(last <= end, last, 0)
    first = np.searchsorted(before, before[1:] - passage_words, "right") - 1
    fits = (before[1:] >= passage_words) & (first >= begin)
    fits &= last[np.maximum(first, 0)] != line + 1
    a = np.concatenate([line[last > 0], first[fits]])
    b = np.concatenate([last[last > 0], line[fits] + 1])
    whole = np.flatnonzero((begin == line) & (before[end] - before[begin] >= seed_words))
    for a, b, salt in ((a, b, 12), (whole, end[whole], 8)):
        out.append((a, b - a, np.ones(len(a), np.int64), hashed(a, b, salt)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _seeds(seed_words: int, passage_words: int):
    def run(batches):
        for batch in batches:
            for texts in K.slices(batch.column(1)):
                h, of, words = worded_lines(texts)
                if not len(h):
                    continue
                a, size, kind, key = runs(h, of, words, seed_words, passage_words)
                ids, mark = (batch.column(k).slice(texts.first, len(texts)).to_numpy() for k in (0, 2))
                place, n = a - np.searchsorted(of, of[a]), np.bincount(of, minlength=len(texts))[of[a]]
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(key)), pa.array(ids[of[a]]), pa.array(mark[of[a]]), *(pa.array(x.astype(np.int32)) for x in (place, size, kind, n))], ["h", "doc_id", "mark", "place", "size", "kind", "n_lines"])

    return run


def _sequences(batches):
    for batch in batches:
        for texts in K.slices(batch.column(1)):
            h, of, _ = worded_lines(texts)
            counts = np.bincount(of, minlength=len(texts))
            some = pa.array(counts > 0)
            ids, mark = (batch.column(k).slice(texts.first, len(texts)).filter(some) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([ids, mark, K.list_array(K.signed(h), counts[counts > 0])], ["doc_id", "mark", "lines"])


def longest_run(q: list[int]) -> list[int]:
    """Indices of a longest ascending subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(q)
    for k, x in enumerate(q):
        pile = bisect_left(tops, x)
        if pile == len(tops):
            tops.append(x)
            piles.append(k)
        else:
            tops[pile], piles[pile] = x, k
        back[k] = piles[pile - 1] if pile else -1
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The aligned places of two sequences, ascending in both."""
    both = set(a) & set(b)
    left, right = [i for i, x in enumerate(a) if x in both], [j for j, x in enumerate(b) if x in both]
    out: list[tuple[int, int]] = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        lo, hi, begin, end = todo.pop()
        while lo < hi and begin < end and a[left[lo]] == b[right[begin]]:
            out.append((left[lo], right[begin]))
            lo, begin = lo + 1, begin + 1
        while lo < hi and begin < end and a[left[hi - 1]] == b[right[end - 1]]:
            hi, end = hi - 1, end - 1
            out.append((left[hi], right[end]))
        if lo == hi or begin == end:
            continue
        here, there = _places(a, left, lo, hi), _places(b, right, begin, end)
        pairs = sorted((p[0], there[x][0]) for x, p in here.items() if len(p) == 1 and len(there.get(x, ())) == 1)
        chain = [pairs[k] for k in longest_run([q for _, q in pairs])]
        if chain:
            # what lies between anchors; the anchors themselves are the heads of these parts
            for (p, q), (p2, q2) in zip([(lo, begin), *chain], [*chain, (hi, end)]):
                todo.append((p, p2, q, q2))
        else:
            pairs = sorted((p, q) for x, ps in here.items() for p, q in zip(ps, there.get(x, ())))
            out += [(left[pairs[k][0]], right[pairs[k][1]]) for k in longest_run([q for _, q in pairs])]
    return sorted(out)


def _places(x: list[int], at: list[int], lo: int, hi: int) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for k in range(lo, hi):
        found.setdefault(x[at[k]], []).append(k)
    return found


def common_blocks(later: list[int], earlier: list[int], rare: set[int]) -> list[tuple[int, int]]:
    """(first, last) of the later document's blocks of aligned lines that hold one of its rare lines."""
    out: list[list[int]] = []
    for p, q in patience(later, earlier):
        if out and (out[-1][1], out[-1][2]) == (p - 1, q - 1):
            out[-1][1:] = p, q
        else:
            out.append([p, p, q])
    marks = sorted(rare)
    return [(p, last) for p, last, _ in out if bisect_left(marks, p) < bisect_left(marks, last + 1)]


def _aligned(batches):
    """Blocks to delete, from rows sorted by their longer document: first its own lines, then its partners with theirs."""
    held: list[tuple] = []
    now, lines = None, []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            key, part, seq, later, doc, mark, partner, rare = row[:2], *row[2:]
            if part == 0:
                now, lines = key, seq
                continue
            assert key == now
            first, second = (seq, lines) if later else (lines, seq)
            held += [(doc, mark, p, q, partner) for p, q in common_blocks(first, second, set(rare))]
        if len(held) >= 2000:
            yield _found_rows(held)
            held = []
    if held:
        yield _found_rows(held)


def _found_rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], ["doc_id", "mark", "first", "last", "partner"])


BLOCKS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("partner", pa.int64())]))


def _joined(batches):
    """One row a document: its blocks without overlaps, each line with the smallest partner that has it."""
    held, n = [], 0
    for (doc, mark), rows in K.grouped(batches, 2):
        spans = sorted(zip(*(rows[c].to_pylist() for c in ("partner", "first", "last"))))
        gone: dict[int, int] = {}
        for name, p, q in spans:
            for line in range(p, q + 1):
                gone.setdefault(line, name)
        blocks: list[tuple[int, int, int]] = []
        for p in sorted(gone):
            if blocks and blocks[-1][1] == p - 1 and blocks[-1][2] == gone[p]:
                blocks[-1] = (blocks[-1][0], p, gone[p])
            else:
                blocks.append((p, p, gone[p]))
        held.append((doc, mark, blocks))
        n += len(blocks)
        if n >= 2000:
            yield _block_rows(held)
            held, n = [], 0
    if held:
        yield _block_rows(held)


def _block_rows(held: list[tuple]) -> pa.RecordBatch:
    blocks = [[dict(zip(("first", "last", "partner"), b)) for b in blocks] for _, _, blocks in held]
    return pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in held]), pa.array([m for _, m, _ in held]), pa.array(blocks, BLOCKS)], ["doc_id", "mark", "blocks"])


def without(text: str, blocks: list[dict]) -> tuple[str, int, int]:
    """The text without these of its worded lines, and how many it had and lost."""
    drop = {p for b in blocks for p in range(b["first"], b["last"] + 1)}
    kept, n = [], 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            if n not in drop:
                kept.append(line)
            n += 1
        else:
            kept.append(line)
    return "\n".join(kept), n, len(drop)


def duplicate_blocks(docs: DataFrame, seed_words: int = 4, rare_holders: int = 16, passage_words: int = 50) -> DataFrame:
    """(doc_id, mark, blocks) of every document that repeats lines of earlier ones; blocks: (first, last, partner), in numbers of worded lines."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null").withColumn("mark", F.xxhash64("text"))
    seeds = rows.mapInArrow(K.tidy(_seeds(seed_words, passage_words)), SEED)
    # repeated rows are one document: only those of repeated ids are shuffled for that, after map-side combine
    again = checkpointed(rows.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "mark"))
    n = again.count()
    lines = rows.mapInArrow(K.tidy(_sequences), LINES)
    if n:
        again = F.broadcast(again) if n <= FEW else again
        seeds = seeds.join(again, ["doc_id", "mark"], "left_anti").unionByName(seeds.join(again, ["doc_id", "mark"], "left_semi").distinct())
        lines = lines.join(again, ["doc_id", "mark"], "left_anti").unionByName(lines.join(again, ["doc_id", "mark"], "left_semi").distinct())
    holders = seeds.groupBy("h").agg(F.min(F.struct("doc_id", "mark", "n_lines")).alias("o"), F.max(F.struct("doc_id", "mark")).alias("l"), F.count("*").alias("n"), F.max("kind").alias("kind"))
    # a frequent line brings nobody together: only rare ones and passages are joined. Checkpointed, so that the join is of two plain shuffles, of which a very common passage's rows can be split
    brings = holders.filter(F.col("o.doc_id").isNotNull() & ((F.col("o.doc_id") != F.col("l.doc_id")) | (F.col("o.mark") != F.col("l.mark"))) & ((F.col("kind") == 1) | (F.col("n") <= rare_holders)))
    shared = checkpointed(brings.select("h", F.col("o.doc_id").alias("partner"), F.col("o.mark").alias("partner_mark"), F.col("o.n_lines").alias("partner_lines")))
    met = stored(seeds.join(shared, "h").filter("doc_id <> partner or mark <> partner_mark").drop("h"))
    passages = met.filter("kind = 1").select("doc_id", "mark", F.col("place").alias("first"), (F.col("place") + F.col("size") - 1).alias("last"), "partner")
    found = passages.union(_pairs_aligned(met.filter("kind = 0"), lines))
    dealt = found.repartition(partitions(spark), "doc_id", "mark").sortWithinPartitions("doc_id", "mark")
    return dealt.mapInArrow(K.tidy(_joined), "doc_id long, mark long, blocks array<struct<first:int,last:int,partner:long>>")


def _pairs_aligned(met: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, mark, first, last, partner): the common blocks of all pairs that met through rare seeds."""
    at = F.explode(F.when(F.col("size") == 1, F.array("place")).otherwise(F.array("place", F.col("place") + 1)))
    pairs = met.withColumn("line", at).groupBy("doc_id", "mark", "partner", "partner_mark", "n_lines", "partner_lines").agg(F.collect_set("line").alias("rare"))
    later = F.col("n_lines") <= F.col("partner_lines")  # the later document is the shorter one, which travels
    side = lambda a, b: F.when(later, F.col(a)).otherwise(F.col(b))
    pairs = stored(pairs.select(side("partner", "doc_id").alias("long_id"), side("partner_mark", "mark").alias("long_mark"), side("doc_id", "partner").alias("short_id"), side("mark", "partner_mark").alias("short_mark"), later.alias("later"), "doc_id", "mark", "partner", "rare"))
    keys = [pairs.select(F.col(f"{s}_id").alias("doc_id"), F.col(f"{s}_mark").alias("mark")) for s in ("long", "short")]
    held = stored(lines.join(keys[0].union(keys[1]).distinct(), ["doc_id", "mark"], "left_semi"))
    short = pairs.join(held.select(F.col("doc_id").alias("short_id"), F.col("mark").alias("short_mark"), "lines"), ["short_id", "short_mark"])
    long = held.join(keys[0].distinct(), ["doc_id", "mark"], "left_semi")
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = long.select(F.col("doc_id").alias("long_id"), F.col("mark").alias("long_mark"), F.lit(0).alias("part"), "lines", nothing("boolean", "later"), *[nothing("long", c) for c in ("doc_id", "mark", "partner")], nothing("array<int>", "rare"))
    rows = rows.union(short.select("long_id", "long_mark", F.lit(1), "lines", "later", "doc_id", "mark", "partner", "rare"))
    dealt = rows.repartition(partitions(rows.sparkSession), "long_id", "long_mark").sortWithinPartitions("long_id", "long_mark", "part")
    return dealt.mapInArrow(K.tidy(_aligned), FOUND)


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """Every row of `docs`, with `text` without duplicate blocks, and n_lines, n_deleted and blocks beside the other columns."""
    key, mark = unused("found_id", docs), unused("found_mark", docs)
    found = stored(duplicate_blocks(docs, **how).select(F.col("doc_id").alias(key), F.col("mark").alias(mark), "blocks"))
    docs = docs.drop("n_lines", "n_deleted", "blocks")
    size = found.agg(F.count("*").alias("n"), F.sum(F.size("blocks")).alias("b")).first()
    few = size["n"] + (size["b"] or 0) <= FEW
    place = docs.columns.index("text")
    same = (docs["doc_id"].cast("long") == found[key]) & (F.xxhash64(docs["text"].cast("string")) == found[mark])
    joined = docs.join(F.broadcast(found) if few else found, same, "left").drop(key, mark)
    schema = docs.select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_deleted"), F.lit(None).cast("array<struct<first:int,last:int,partner:long>>").alias("blocks")).schema
    return joined.mapInArrow(K.tidy(_cleaned(place)), schema)


def _cleaned(place: int):
    def run(batches):
        for batch in batches:
            blocks = batch.column(batch.num_columns - 1).to_pylist()
            texts, n, gone = [], [], []
            for text, b in zip(batch.column(place).to_pylist(), blocks):
                new, a, d = without(text, b or []) if text is not None else (None, 0, 0)
                texts.append(new)
                n.append(a)
                gone.append(d)
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            kept = batch.columns[-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), kept], [*batch.schema.names[:-1], "n_lines", "n_deleted", "blocks"])

    return run
