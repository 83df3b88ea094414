"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are `[^\\x20\\x09-\\x0D]+` in lower case. A word n-gram that few items have is a seed by itself. One that more than `COMMON` items have, such as "which
of the following is", is a seed only for those of its items of which the document has a rarer word too, near by. No copy is lost by that: a
score of `least` needs that share of an item's words, so one at least of the rarest others, however the words are ranked; they are by the number of items that have
them. Grams of a document that no item has cost nothing, and ones that an edit broke don't matter, as every intact one is looked at.
Wherever a document has a seed, the words around it are aligned with the item by Smith-Waterman (match 2,
mismatch -1, gap -1), unless they have too few words of the item for the least score; overlapping windows of one item
are joined. The score is the best local alignment's over that of the item with itself: 1 for an exact copy, less for
edited or partial ones. A copy in which no n words in a row are intact is not found. Documents are only mapped over,
so hot sources and copies cost no shuffle. The items, a query set, are handled in blocks of at most `block` words in
all, each sent to the tasks whole.

Items with fewer words than n have one seed, all their words; items without words, with a null id or a null text match nothing. Repeated item
ids are items of their own, of which the best counts; of places with the same score the first. Null and empty documents have no words, repeated
rows match alike, empty tables match nothing; a very long text is one array of word hashes, never cut. A null doc_id stays null in the result.
Columns beside doc_id and text don't matter, whatever their names (`drop_contaminated` carries them along).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._shared import stored, unused

GRAM = 4
BLOCK_WORDS = 1_000_000
COMMON = 32  # items that may share a gram that is a seed by itself
HELD_WORDS = 4_000_000  # rarer words of the common grams' items that a task keeps at hand


class Items:
    """Word hashes of a block of items and their n-grams."""

    def __init__(self, ids: list[int], texts: list[str], n: int = GRAM, most: int = COMMON):
        self.n, self.most, self.ids, self.words = n, most, ids, []
        for part in K.slices(pc.utf8_lower(pa.array(texts, pa.large_string()))):
            starts, ends, of = part.words()
            h = part.hashes(starts, ends)
            cut = np.searchsorted(of, np.arange(len(part) + 1))
            self.words += [h[a:b] for a, b in zip(cut[:-1], cut[1:])]
        gram, item, at = [], [], []
        for k, w in enumerate(self.words):
            g, _, first = K.shingles(w, np.zeros(len(w), np.int64), 1, n)
            gram.append(g)
            item.append(np.full(len(g), k))
            at.append(first)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        gram, item, at = join(gram, np.uint64), join(item, np.int64), join(at, np.int64)
        order = np.argsort(gram, kind="stable")
        #: the seeds: every n-gram with its item and place, by hash
        self.gram, self.item, self.at = gram[order], item[order], at[order]
        self.bags = [np.unique(w, return_counts=True) for w in self.words]
        #: lengths of whole items that are shorter than n: documents' runs of that length are hashed too
        self.short = sorted({len(w) for w in self.words if 0 < len(w) < n})

        held = np.concatenate([b[0] for b in self.bags]) if self.bags else np.zeros(0, np.uint64)
        #: every word with the number of items that have it
        self.vocabulary, self.holders = np.unique(held, return_counts=True)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self._near: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        self._held = 0

    def rarer(self, k: int, least: float) -> np.ndarray:
        """The rarest words of item k, so many that any `least` of its words has one of them."""
        words = self.words[k]
        need = max(1, math.ceil(least * len(words) - 1e-9))
        rank = self.holders[np.searchsorted(self.vocabulary, words)]
        return np.unique(words[np.argsort(rank, kind="stable")[: len(words) - need + 1]])

    def near(self, lo: int, hi: int, least: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Of the seeds lo to hi of a common gram, by classes of item length: the reach in words, the rarer words, and the seed of each."""
        found = self._near.get(lo)
        if found is None:
            if self._held > HELD_WORDS:
                self._near.clear()
                self._held = 0
            found, seeds = [], np.arange(lo, hi)
            kind = np.ceil(np.log2(np.maximum(self.sizes[self.item[lo:hi]], 16)) / 2)
            for c in np.unique(kind):
                some = seeds[kind == c]
                parts = [self.rarer(int(self.item[e]), least) for e in some]
                word, seed = np.concatenate(parts), np.repeat(some, [len(x) for x in parts])
                order = np.argsort(word, kind="stable")
                longest = int(self.sizes[self.item[some]].max())
                found.append((longest + longest // 2 + 2, word[order], seed[order]))
                self._held += len(word)
            self._near[lo] = found
        return found

    def common(self, k: int, text: np.ndarray) -> int:
        """Words of the text that item k has too, its own number of times at most: no alignment matches more."""
        values, times = self.bags[k]
        at = np.minimum(np.searchsorted(values, text), len(values) - 1)
        return int(np.minimum(np.bincount(at[values[at] == text], minlength=len(values)), times).sum())


def runs_of(words: np.ndarray, of: np.ndarray, texts: int, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the documents' n-grams, and of the runs as long as the short items."""
    gram, _, at = K.shingles(words, of, texts, items.n, whole=False)
    grams, places = [gram], [at]
    for size in items.short:
        keep = np.flatnonzero(of[size - 1 :] == of[: len(of) - size + 1]) if len(of) >= size else np.zeros(0, np.int64)
        h = np.full(len(keep), size, np.uint64)
        for j in range(size):
            h = K.mix(h * np.uint64(0x2545F4914F6CDD1D) + words[keep + j], 7)
        grams.append(h)
        places.append(keep)
    return np.concatenate(grams), np.concatenate(places)


def smith_waterman(item: np.ndarray, text: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """The best local score, and the end of its span in the text. One vector operation chain for each word of the item."""
    n = len(text)
    row, slope = np.zeros(n + 1, np.int64), -gap * np.arange(n + 1)
    best, end = 0, 0
    for w in item:
        now = np.zeros(n + 1, np.int64)
        np.maximum(row[:-1] + np.where(text == w, match, mismatch), row[1:] + gap, out=now[1:])
        np.maximum(now, 0, out=now)
        row = np.maximum.accumulate(now + slope) - slope  # gaps along the text
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _with_rarer_words(block: Items, least: float, words, of, begin, places, lo, hits, many) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and places of common grams' hits, for the items of which the text has a rarer word in reach."""
    seeds, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(hits):
        order = np.lexsort((places[hits], lo[hits], of[places[hits]]))
        hits = hits[order]
        cut = np.flatnonzero(np.append(True, (lo[hits[1:]] != lo[hits[:-1]]) | (of[places[hits[1:]]] != of[places[hits[:-1]]])))
        for a, b in zip(cut, np.append(cut[1:], len(hits))):
            here = places[hits[a:b]]
            gram, d = int(lo[hits[a]]), int(of[here[0]])
            for reach, rarer, seed in block.near(gram, gram + int(many[hits[a]]), least):
                first, last = np.maximum(here - reach, begin[d]), np.minimum(here + reach, begin[d + 1])
                first = np.maximum(first, np.append(begin[d], last[:-1]))  # places ascend: nothing twice
                around = np.unique(words[K.ragged(first, np.maximum(last - first, 0))])
                start = np.searchsorted(rarer, around, "left")
                n = np.searchsorted(rarer, around, "right") - start
                met = np.unique(seed[K.ragged(start[n > 0], n[n > 0])])
                seeds.append(np.tile(met, len(here)))
                at.append(np.repeat(here, len(met)))
    return np.concatenate(seeds), np.concatenate(at)


def _aligned(items, least: float):
    def run(batches):
        block: Items = items.value
        for batch in batches:
            for texts in K.slices(pc.utf8_lower(batch.column(1))):
                starts, ends, of = texts.words()
                words = texts.hashes(starts, ends)
                grams, places = runs_of(words, of, len(texts), block)
                lo = np.searchsorted(block.gram, grams, "left")
                many = np.searchsorted(block.gram, grams, "right") - lo
                some = np.flatnonzero(many)
                if not len(some):
                    continue
                begin = np.searchsorted(of, np.arange(len(texts) + 1))
                rare = some[many[some] <= block.most]
                which, place = K.ragged(lo[rare], many[rare]), np.repeat(places[rare], many[rare])
                more = _with_rarer_words(block, least, words, of, begin, places, lo, some[many[some] > block.most], many)
                which, place = np.concatenate([which, more[0]]), np.concatenate([place, more[1]])
                found: dict[tuple[int, int], list[int]] = {}
                for d, k, start in zip(of[place].tolist(), block.item[which].tolist(), (place - block.at[which]).tolist()):
                    found.setdefault((d, k), []).append(start)
                ids = batch.column(0).slice(texts.first, len(texts)).to_pylist()
                out = []
                for (d, k), at in found.items():
                    item = block.words[k]
                    pad = len(item) // 2 + 2
                    spans: list[list[int]] = []
                    for s in sorted(set(at)):
                        a, b = max(int(begin[d]), s - pad), min(int(begin[d + 1]), s + len(item) + pad)
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                    top = (0, 0, 0)
                    for a, b in spans:
                        if 2 * block.common(k, words[a:b]) < least * 2 * len(item):
                            continue
                        score, end = smith_waterman(item, words[a:b])
                        if score > top[0]:
                            top = (score, a, a + end)
                    score = top[0] / (2 * len(item))
                    if score >= least:
                        _, back = smith_waterman(item[::-1], words[top[1] : top[2]][::-1])
                        out.append((ids[d], block.ids[k], score, top[2] - back - int(begin[d]), top[2] - int(begin[d])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (batch.schema.field(0).type, pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "first_word", "end_word"])

    return run


def blocks_of(benchmark: DataFrame, most: int = BLOCK_WORDS, n: int = GRAM, common: int = COMMON):
    """The items in blocks of bounded size, read one after the other."""
    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text")
    ids, texts, words = [], [], 0
    for row in rows.toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        words += len(row["text"].split())
        if words >= most:
            yield Items(ids, texts, n, common)
            ids, texts, words = [], [], 0
    if ids:
        yield Items(ids, texts, n, common)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, n: int = GRAM, block: int = BLOCK_WORDS, common: int = COMMON) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of every document and item that align with a score of `least` or more; the span is of the document's words."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, score double, first_word long, end_word long"
    out = None
    for items in blocks_of(benchmark, block, n, common):
        if not len(items.gram):
            continue
        part = rows.mapInArrow(K.tidy(_aligned(spark.sparkContext.broadcast(items), least)), schema)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out


def best_matches(found: DataFrame) -> DataFrame:
    """One row a document and item, the one with the best score."""
    best = F.max(F.struct("score", (-F.col("first_word")).alias("f"), "end_word")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", (-F.col("b.f")).alias("first_word"), "b.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose texts align with no item; rows with a null id are judged by their own text too."""
    row = unused("row_hash", docs)
    marked = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    named = marked.select(F.col(row).alias("doc_id"), "text")
    bad = stored(contaminated(named, benchmark, least).select(F.col("doc_id").alias(row)).distinct())  # aligned once
    few = bad.count() <= 1_000_000
    return marked.join(F.broadcast(bad) if few else bad, row, "left_anti").select(docs.columns)
