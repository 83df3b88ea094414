"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of `passage` words. Each passage is encoded from its bytes and words; a
gated attention layer (tanh times sigmoid, softmax over the bag) learns from document labels which
passages decide, and the attention-weighted mean of the encodings is scored. All weights
are fitted together, by Adam, on labelled rows outside the held-out fold: at most about `per_class` of each
label, and of a text of more than `sample_chars` characters so many, in pieces from all over it. Scoring reads every whole text,
in slices of bounded size; a long text has more passages and no other treatment. Null, empty and blank texts have
one passage without content. Labels of a repeated id count once, the lower one. Without
labels of both kinds every score is one half. Repeated rows are scored alike, an empty table gives an empty one; columns beside
doc_id and text don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from .toxicity_grammar import sampled

PASSAGE = 64
BLOCK = 2048  # passages of a long text that are encoded at once
HASHED = 24
#: Bytes that count one by one, as shares of the passage.
MARKS = b"#*$%&|<>!?.,;:\"'()[]{}@=_/\\-+~^"
_CLASS = np.zeros((6, 256), np.float32)
_CLASS[0, 65:91] = 1
_CLASS[1, 97:123] = 1
_CLASS[2, 48:58] = 1
_CLASS[3, 128:] = 1
_CLASS[4, list(b"#*$%&|<>")] = 1
_CLASS[5, list(MARKS)] = 1
COLUMNS = len(_CLASS) + len(MARKS) + 9 + HASHED


def encode(texts: K.Texts, passage: int = PASSAGE, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages, and how many each text has (one at least); a very long text in blocks of so many passages."""
    if len(texts) > 1 or len(texts.data) <= block * passage * 8:
        return _encode(texts, passage, None)[:2]
    starts, ends, _ = texts.words()
    out, last = [], None
    for lo in range(0, max(1, len(starts)), block * passage):
        hi = min(len(starts), lo + block * passage)
        data = texts.data[starts[lo] : ends[hi - 1]] if hi > lo else texts.data[:0]
        x, _, last = _encode(K.Texts(data, np.array([0, len(data)]), texts.first), passage, last)
        out.append(x)
    return np.concatenate(out), np.array([sum(map(len, out))])


def _encode(texts: K.Texts, passage: int, before: np.uint64 | None) -> tuple[np.ndarray, np.ndarray, np.uint64 | None]:
    """The same and the hash of the last word; before: that of the word before the first one."""
    starts, ends, of = texts.words()
    count = np.bincount(of, minlength=len(texts))
    first = np.cumsum(count) - count
    rank = np.arange(len(of)) - first[of]
    pieces = np.maximum(1, -(-count // passage))
    base = np.cumsum(pieces) - pieces
    piece = base[of] + rank // passage
    n = int(pieces.sum())
    words = np.bincount(piece, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    out = np.zeros((n, COLUMNS), np.float32)
    length = (ends - starts).astype(np.float64)
    size = np.bincount(piece, length, n)
    byte = np.maximum(size, 1)
    data = texts.data
    inside = K.ragged(starts, ends - starts)
    owner = np.repeat(piece, ends - starts)
    hist = np.bincount(owner * 256 + data[inside], minlength=n * 256).reshape(n, 256) if n * 256 < 1 << 26 else np.stack([np.bincount(owner[data[inside] == b], minlength=n) for b in range(256)], 1)
    share = (hist / byte[:, None]).astype(np.float32)
    k = len(_CLASS)
    out[:, :k] = share @ _CLASS.T
    out[:, k : k + len(MARKS)] = share[:, list(MARKS)]
    k += len(MARKS)
    h = texts.hashes(starts, ends, lower=True)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    if len(h) and before is not None:
        same[0] = h[0] == before
    order = np.lexsort((h, piece))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (piece[order][1:] != piece[order][:-1])
    distinct = np.bincount(piece[order][fresh], minlength=n)
    upper = (data[starts] >= 65) & (data[starts] <= 90) if len(starts) else np.zeros(0, bool)
    mean = size / some
    out[:, k] = words / passage
    out[:, k + 1] = mean / 10
    out[:, k + 2] = np.sqrt(np.maximum(0, np.bincount(piece, length**2, n) / some - mean**2)) / 10
    out[:, k + 3] = np.bincount(piece[same], minlength=n) / some
    out[:, k + 4] = distinct / some
    out[:, k + 5] = np.bincount(piece[upper], minlength=n) / some
    out[:, k + 6] = np.bincount(piece[length == 1], minlength=n) / some
    out[:, k + 7] = np.bincount(piece[length > 20], minlength=n) / some
    out[:, k + 8] = words == 0
    k += 9
    slot = (h % np.uint64(HASHED)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    out[:, k:] = np.bincount(piece * HASHED + slot, sign, n * HASHED).reshape(n, HASHED) / np.sqrt(some)[:, None]
    return out, pieces, h[-1] if len(h) else before


class Model:
    """Encoder, gated attention and score; everything the scoring of a bag needs."""

    def __init__(self, shift, scale, weights: dict[str, np.ndarray]):
        self.shift, self.scale, self.w = shift, scale, weights

    def forward(self, x: np.ndarray, pieces: np.ndarray) -> dict:
        w = self.w
        first = np.cumsum(pieces) - pieces
        e = np.tanh(x @ w["e"] + w["e0"])
        v, u = np.tanh(e @ w["v"]), 1 / (1 + np.exp(-np.clip(e @ w["u"], -30, 30)))
        s = (v * u) @ w["a"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, first), pieces))
        att = s / np.repeat(np.add.reduceat(s, first), pieces)
        z = np.add.reduceat(att[:, None] * e, first)
        logit = z @ w["c"] + w["c0"]
        return {"x": x, "e": e, "v": v, "u": u, "att": att, "z": z, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30))), "first": first, "pieces": pieces}

    def gradients(self, f: dict, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, pieces = self.w, f["pieces"]
        d = (f["p"] - y) * weight
        dz = np.repeat(d[:, None] * w["c"], pieces, 0)
        along = (dz * f["e"]).sum(1)
        mean = np.repeat(np.add.reduceat(f["att"] * along, f["first"]), pieces)
        ds = f["att"] * (along - mean)
        dv = ds[:, None] * w["a"] * f["u"] * (1 - f["v"] ** 2)
        du = ds[:, None] * w["a"] * f["v"] * f["u"] * (1 - f["u"])
        de = (f["att"][:, None] * dz + dv @ w["v"].T + du @ w["u"].T) * (1 - f["e"] ** 2)
        return {"c": f["z"].T @ d, "c0": d.sum(keepdims=True), "a": (f["v"] * f["u"]).T @ ds, "v": f["e"].T @ dv, "u": f["e"].T @ du, "e": f["x"].T @ de, "e0": de.sum(0)}

    def score(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for texts in K.slices(column):
            x, pieces = encode(texts)
            out.append(self.forward((x - self.shift) / self.scale, pieces)["p"])
        return np.concatenate(out)


def fit(texts: list[str], labels: list[int], hidden: int = 24, gate: int = 12, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    shape = {"e": (COLUMNS, hidden), "e0": (hidden,), "v": (hidden, gate), "u": (hidden, gate), "a": (gate,), "c": (hidden,), "c0": (1,)}
    w = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "ac" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return Model(np.zeros(COLUMNS, np.float32), np.ones(COLUMNS, np.float32), {k: v * 0 for k, v in w.items()})
    parts = [encode(t) for t in K.slices(pa.array(texts, pa.large_string()))]
    x, pieces = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    shift, scale = x.mean(0), x.std(0) + 0.02
    x = (x - shift) / scale
    first = np.cumsum(pieces) - pieces
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32) * len(y)
    m, s2, t = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    model = Model(shift, scale, w)
    for epoch in range(epochs):
        step = rate * (1 if epoch < epochs * 2 // 3 else 0.2)
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            f = model.forward(x[K.ragged(first[rows], pieces[rows])], pieces[rows])
            t += 1
            for k, g in model.gradients(f, y[rows], weight[rows] / len(rows)).items():
                g = g + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s2[k] = 0.999 * s2[k] + 0.001 * g * g
                w[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(s2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1, per_class: int = 2500, sample_chars: int = 20_000) -> Model:
    texts, y = sampled(docs, labels, "quality", fold, held, per_class, sample_chars)
    return fit(texts, y)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row; score: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            p = shared.value.score(batch.column(1)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(K.tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
