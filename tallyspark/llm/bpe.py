"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding.

A text is cut into words by the vocabulary file's pre-tokenizer pattern. The distinct words of a
slice that the task hasn't met yet are encoded together: their symbols lie in one flat array, each
round looks every adjacent pair up by binary search over the sorted pair keys, finds each word's
lowest rank and merges that pair everywhere in the word. As a word takes a round for each rank, words of more than `LONG`
bytes are merged one by one with a heap of their pairs instead, in time nearly proportional to their length. Encoded words are
remembered up to a fixed number of characters, so the memory of a task is that of its longest text.

Null texts count as empty: no tokens, and the digests of nothing. The strings of added tokens
in a text become those tokens, as in the library. Rows are never merged or dropped, repeated ones are encoded alike, an empty
table gives an empty one; other columns don't matter, whatever their names. Of pairs with the same rank the leftmost is merged first.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K

#: The pre-tokenizer pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED_CHARS = 2_000_000
LONG = 512
FAR = np.int64(1) << 40


def printable_bytes() -> list[str]:
    """The character that stands for each byte in vocabulary files: itself if printable, else from U+0100 on."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Vocabulary:
    """What a vocabulary file says, as sorted arrays."""

    def __init__(self, content: str):
        spec = json.loads(content)
        vocab = spec["model"]["vocab"]
        chars = printable_bytes()
        self.byte_id = np.array([vocab[c] for c in chars], np.int64)
        byte_of = {c: b for b, c in enumerate(chars)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.pairs: dict[int, tuple[int, int]] = {}
        for r, (k, m) in enumerate(zip(keys.tolist(), made.tolist())):
            self.pairs.setdefault(k, (r, m))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.content = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        lengths = np.zeros(max(self.content) + 1, np.int64)
        for i, token in self.content.items():
            lengths[i] = len(token)
        self.token_len, self.token_at = lengths, np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(self.content.get(i, b"") for i in range(len(lengths))), np.uint8)


def merge_rounds(symbols: np.ndarray, word: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, given the symbols of one after the other and the word of each symbol."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols) > 1:
        same = word[1:] == word[:-1]
        key = symbols[:-1] << 20 | symbols[1:]
        at = np.minimum(np.searchsorted(vocab.keys, key), len(vocab.keys) - 1)
        rank = np.where(same & (vocab.keys[at] == key), vocab.rank[at], FAR)
        first = np.flatnonzero(np.append(True, ~same))
        low = np.minimum.reduceat(np.append(rank, FAR), first)
        sizes = np.diff(np.append(first, len(symbols)))
        live = np.repeat(low < FAR, sizes)
        if not live.all():
            done.append((symbols[~live], word[~live]))
            if not live.any():
                symbols = word = np.zeros(0, np.int64)
                break
        hit = np.flatnonzero((rank == np.repeat(low, sizes)[:-1]) & (rank < FAR))
        # of overlapping hits, every second counts, from the left
        run = np.append(True, (hit[1:] != hit[:-1] + 1) | (key[hit[1:]] != key[hit[:-1]]))
        hit = hit[(np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
        symbols = symbols.copy()
        symbols[hit] = vocab.made[at[hit]]
        live[hit + 1] = False
        symbols, word = symbols[live], word[live]
    if len(symbols):
        done.append((symbols, word))
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, of = np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])
    order = np.argsort(of, kind="stable")
    return ids[order], of[order]


def merge_heap(symbols: list[int], vocab: Vocabulary) -> list[int]:
    """Token ids of one word: the pair with the lowest rank, of these the leftmost, is taken from a heap until there is none."""
    pairs, n = vocab.pairs, len(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        found = pairs.get(symbols[i] << 20 | symbols[i + 1])
        if found:
            heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
    heapq.heapify(heap)
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = right[i]
        if symbols[i] != a or j == n or symbols[j] != b:
            continue  # one of them was merged before
        symbols[i], symbols[j], right[i] = made, -1, right[j]
        if right[i] < n:
            left[right[i]] = i
        for k in (left[i], i):
            if k >= 0 and right[k] < n:
                found = pairs.get(symbols[k] << 20 | symbols[right[k]])
                if found:
                    heapq.heappush(heap, (found[0], k, symbols[k], symbols[right[k]], found[1]))
    return [s for s in symbols if s >= 0]


class Codec:
    """Encodes and decodes texts in batches; words met before are remembered."""

    def __init__(self, vocab: Vocabulary, remembered: int = REMEMBERED_CHARS):
        self.vocab, self.limit, self.pattern = vocab, remembered, regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        fresh: list[str] = []

        class Words(dict):
            def __missing__(self, w: str) -> int:
                fresh.append(w)
                self[w] = n = len(self)
                return n

        self.words, self.fresh, self.chars = Words(), fresh, 0
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pieces(self, text: str) -> list[str]:
        cut = self.vocab.cut
        if cut is None or not any(t in text for t in self.vocab.added):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in cut.split(text):
            out += ["\0" + part] if part in self.vocab.added else self.pattern.findall(part)
        return out

    def learn(self) -> None:
        """Encodes the fresh words and adds them to what is remembered."""
        if not self.fresh:
            return
        special = {k: self.vocab.added[w[1:]] for k, w in enumerate(self.fresh) if w[:1] == "\0" and w[1:] in self.vocab.added}
        raw = [b"" if k in special else w.encode() for k, w in enumerate(self.fresh)]
        lengths = np.array([len(b) for b in raw], np.int64)
        one_by_one = {k: [i] for k, i in special.items()}
        for k in np.flatnonzero(lengths > LONG).tolist():
            one_by_one[k] = merge_heap(self.vocab.byte_id[np.frombuffer(raw[k], np.uint8)].tolist(), self.vocab)
            raw[k], lengths[k] = b"", 0
        symbols = self.vocab.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        ids, of = merge_rounds(symbols, np.repeat(np.arange(len(raw)), lengths), self.vocab)
        if one_by_one:
            of = np.concatenate([of, np.repeat(list(one_by_one), [len(x) for x in one_by_one.values()])]).astype(np.int64)
            order = np.argsort(of, kind="stable")
            ids, of = np.concatenate([ids, *one_by_one.values()]).astype(np.int64)[order], of[order]
        size = np.bincount(of, minlength=len(raw))
        self.at = np.append(self.at, len(self.ids) + np.cumsum(size) - size)
        self.size, self.ids = np.append(self.size, size), np.append(self.ids, ids)
        self.chars += sum(map(len, self.fresh))
        self.fresh.clear()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        if self.chars > self.limit:
            self.forget()
        find, found = self.words.__getitem__, []
        for text in texts:
            words = self.pieces(text)
            found.append(np.fromiter(map(find, words), np.int64, len(words)))
        self.learn()
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        size = self.size[flat]
        sums = np.append(0, np.cumsum(size))
        cut = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int64)
        return self.ids[K.ragged(self.at[flat], size)], np.diff(sums[cut])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of these tokens; tokens of a whole text are its UTF-8."""
        return self.vocab.token_bytes[K.ragged(self.vocab.token_at[ids], self.vocab.token_len[ids])].tobytes()


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read())


def _coded(content, with_ids: bool):
    codec: list[Codec] = []

    def run(batches):
        if not codec:
            codec.append(Codec(Vocabulary(content.value)))
        for batch in batches:
            for part in K.slices(batch.column(1), 1 << 20):
                rows = batch.slice(part.first, len(part))
                ids, counts = codec[0].encode([t or "" for t in rows.column(1).to_pylist()])
                cut = np.append(0, np.cumsum(counts))
                out = [rows.column(0), pa.array(counts)]
                small = ids.astype("<u4")
                texts = [codec[0].decode(ids[a:b]).decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]
                if with_ids:
                    out += [K.list_array(ids.astype(np.int32), counts), pa.array(texts)]
                else:
                    out += [pa.array([hashlib.sha256(small[a:b].tobytes()).hexdigest() for a, b in zip(cut[:-1], cut[1:])]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", *(("ids", "decoded") if with_ids else ("ids_sha256", "decoded_sha256"))])

    return run


def _source(docs: DataFrame, path: str):
    """The vocabulary file's content goes with the job: executors need not have the file."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row of `docs` (doc_id, text); vocabulary: the path of its file."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(K.tidy(_coded(_source(docs, vocabulary), True)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The same, but for SHA-256 digests of ids and decoded text: the rows stay small."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(K.tidy(_coded(_source(docs, vocabulary), False)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
