"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon maps words to classes (insult, threat, target, negation, report). Four small deterministic
transducers over these classes are composed: negation turns what follows it closely into its
negated form, reported speech marks what is said or called by someone, target attaches a person
addressed or named nearby, and the scorer gives each resulting symbol its weight. A clause is
scored by the path its words take through the composition; a document by the clauses that matched.

Insult patterns are learned from labelled documents, besides a short fixed list; so are the
weights. The fit uses a sample of labelled rows of bounded size (about `per_class` of each
label; of a text of more than `sample_chars` characters so many, in `WINDOWS` pieces at even distances from its beginning to its end); scoring reads every whole text.
Null and empty texts have no clause and get the score of the bias alone. Without usable labels the fixed list and the
prior weights remain. Labels of a repeated id count once, toxic if any says so. Repeated rows are scored alike, an empty table gives
an empty one; columns beside doc_id and text don't matter, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._shared import bucket

# Words of the classes, in the four languages of the corpus.
INSULTS = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless", "imbecile", "dumbass", "bastard", "vermin", "dummkopf", "vollidiot", "abschaum", "arschloch", "connard", "crétin", "salaud", "imbécile", "estúpido", "imbécil", "escoria", "cabrón"]
THREATS = ["kill", "murder", "hurt", "destroy", "strangle", "töte", "umbringen", "tuer", "matar", "mataré"]
TARGETS = ["you", "your", "you're", "yourself", "he", "she", "they", "them", "people", "du", "dich", "dir", "ihr", "euch", "sie", "tu", "toi", "vous", "eux", "tú", "usted", "ustedes", "vosotros", "ellos"]
NEGATIONS = ["not", "no", "never", "isn't", "aren't", "don't", "won't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás"]
REPORTS = ["said", "says", "called", "quoted", "quote", "reported", "wrote", "sagte", "nannte", "schrieb", "dit", "appelé", "écrit", "dijo", "llamó", "escribió", '"', "“", "«", "„"]

CLASSES = {**{w: "T" for w in TARGETS}, **{w: "N" for w in NEGATIONS}, **{w: "R" for w in REPORTS}}
KINDS = ["insult", "insult at target", "negated", "reported", "threat", "threat at target"]
#: The weights before any label is seen: log-odds a clause of each kind adds.
PRIOR = np.array([3.0, 4.0, 1.0, 1.0, 0.5, 3.0])
BIAS = -2.5
_END = re.compile(r"[.!?;:,\n]")
_WORD = re.compile(r"\w+(?:'\w+)*|[\"“«„]")


WINDOWS = 16  # pieces of a long labelled text
SALTS = (0, 0x5BD1E995, 0x9E3779B9, 0x85EBCA6B)


def hash_of(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace"))


class Transducer:
    """Deterministic, total: step(state, symbol) gives the next state and the output symbol; states are made on demand."""

    def __init__(self, start, step):
        self.start, self._step, self._known = start, step, {}

    def step(self, state, symbol):
        known = self._known.get((state, symbol))
        if known is None:
            known = self._known[state, symbol] = self._step(state, symbol)
        return known

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: what this one puts out, the other reads."""

        def step(state, symbol):
            a, middle = self.step(state[0], symbol)
            b, out = other.step(state[1], middle)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def run(self, symbols):
        state = self.start
        for s in symbols:
            state, out = self.step(state, s)
            yield out


def negation(reach: int = 3) -> Transducer:
    """I -> i and H -> h within `reach` words after a negation."""

    def step(left, s):
        if s == "N":
            return reach, "O"
        return max(0, left - 1), (s.lower() if left and s in "IH" else s)

    return Transducer(0, step)


def reporting(reach: int = 6) -> Transducer:
    """I and H -> r within `reach` words after a verb of report or an opening quote."""

    def step(left, s):
        if s == "R":
            return reach, "O"
        return max(0, left - 1), ("r" if left and s in "IH" else s)

    return Transducer(0, step)


def targeting(reach: int = 4) -> Transducer:
    """I -> J and H -> K within `reach` words after a target."""

    def step(left, s):
        if s == "T":
            return reach, "O"
        return max(0, left - 1), ({"I": "J", "H": "K"}.get(s, s) if left else s)

    return Transducer(0, step)


def scoring() -> Transducer:
    """The kind of each symbol, by its place in KINDS; None for other words."""
    kind = {"I": 0, "J": 1, "i": 2, "h": 2, "r": 3, "H": 4, "K": 5}
    return Transducer(0, lambda state, s: (0, kind.get(s)))


GRAMMAR = (negation() @ reporting()) @ targeting() @ scoring()


class Lexicon:
    """Insult patterns, "stem+" for words that go on after the stem and "word$" for whole words, and threat words."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        heads: list[str] = []  # no head begins with another one
        for w in sorted({*(s[:-1] for s in stems), *THREATS}):
            if not heads or not w.startswith(heads[-1]):
                heads.append(w)
        self.find = re.compile("|".join(map(re.escape, heads)))
        self.lengths = sorted({len(s) - 1 for s in stems}, reverse=True)

    def weight(self, word: str) -> float:
        whole = self.stems.get(word + "$")
        if whole is not None:
            return whole
        return next((self.stems[word[:n] + "+"] for n in self.lengths if n < len(word) and word[:n] + "+" in self.stems), 0.0)

    def symbol(self, word: str) -> str:
        known = CLASSES.get(word)
        return known or ("I" if self.weight(word) else "H" if word in THREATS else "O")


def clause_kinds(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """For each kind, the weighted number of clauses of the text whose path has it."""
    out = np.zeros(len(KINDS))
    if not text:
        return out
    text = text.lower()
    done = -1
    for m in lexicon.find.finditer(text):
        at = m.start()
        if at < done or at and text[at - 1].isalpha():
            continue
        end, before = _END.search(text, at), done
        done = end.start() if end else len(text)
        begin = max(text.rfind(c, max(before, 0), at) for c in ".!?;:,\n") + 1  # the clause before ended with a mark: none further back matters
        words = _WORD.findall(text, begin, done)
        best: dict[int, float] = {}
        for word, kind in zip(words, GRAMMAR.run([lexicon.symbol(w) for w in words])):
            if kind is not None:
                best[kind] = best.get(kind, 0.0) + (lexicon.weight(word) or 1.0)
        for kind, w in best.items():
            out[kind] += w
    return out


def patterns(text: str, low: int = 3, high: int = 9, longest: int = 24) -> set[str]:
    """What could be a pattern in this text: its words, and their beginnings with something after them."""
    words = set(re.findall(r"[^\W\d_]{%d,%d}" % (low, longest), text.lower()))
    return {w[:n] + "+" for w in words for n in range(low, min(high + 1, len(w)))} | {w + "$" for w in words}


def _rare(k: int, mean: float) -> float:
    """The probability of k or more events where `mean` are expected."""
    term = math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
    total = 0.0
    for j in range(k, k + 60):
        total += term
        term *= mean / (j + 1)
    return total


def once(texts: list[str], minima: int = 3) -> list[int]:
    """Indices of texts without near copies before them: the words of a copied text are no independent evidence."""
    seen: list[set[int]] = [set() for _ in range(minima)]
    out = []
    for k, t in enumerate(texts):
        words = t.lower().split()
        grams = {hash_of(" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))}
        marks = [min(g ^ salt for g in grams) for salt in SALTS[:minima]]
        if not any(m in s for m, s in zip(marks, seen)):
            out.append(k)
        for m, s in zip(marks, seen):
            s.add(m)
    return out


def learn_stems(texts: list[str], labels: list[int], doubt: float = 1e-4) -> dict[str, float]:
    """Patterns that mark the label, with their weights: a quarter of the log-odds, 2.5 at most.

    A pattern must be far more frequent in toxic texts than chance allows, given how many patterns there are
    to choose from (`doubt`: the expected number of accidental ones). The fixed list is kept but for words that the labels contradict.
    """
    lone = once(texts)
    texts, labels = [texts[k] for k in lone], [labels[k] for k in lone]
    yes: Counter = Counter()
    count = [0, 0]
    for t, y in zip(texts, labels):
        count[y] += 1
        if y == 1:
            yes.update(patterns(t))
    forms = Counter(p[:n] + "+" for p in yes if p[-1] == "$" and yes[p] > 1 for n in range(3, len(p) - 1))
    kept = {p for p, n in yes.items() if n >= 3}
    no: Counter = Counter()
    for t, y in zip(texts, labels):
        if y == 0:
            no.update(patterns(t) & kept)
    ratio = count[1] / max(1, count[0])

    def weight(p: str) -> float:
        return min(2.5, math.log((yes[p] + 0.5) / (count[1] + 1) / ((no[p] + 0.5) / (count[0] + 1))) / 4)

    stems = {w + "$": max(1.0, weight(w + "$")) for w in INSULTS if not no[w + "$"] * ratio > yes[w + "$"]}
    stems |= {w + "+": 0.8 for w in INSULTS if len(w) > 4 and not no[w + "+"] * ratio > yes[w + "+"]}
    # a beginning counts if several words share it, and only as specific as the evidence allows
    top: dict[str, int] = {}
    for p in kept:
        if p[-1] == "+":
            for n in range(3, len(p) - 1):
                top[p[:n]] = max(top.get(p[:n], 0), yes[p])
    broad = {p for p in kept if p[-1] == "+" and (forms[p] < 4 or top.get(p[:-1], 0) >= 0.95 * yes[p])}
    for p in kept - broad:
        if weight(p) >= 0.9 and _rare(yes[p], (no[p] + 0.5) * ratio) * len(yes) < doubt:
            stems[p] = weight(p)
    return stems


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Logistic weights (bias last) with a Gaussian prior around PRIOR, by Newton's steps."""
    prior = np.append(PRIOR, BIAS)
    w, x = prior.copy(), np.column_stack([x, np.ones(len(x))])
    loss = lambda v: np.logaddexp(0, -np.where(y > 0, 1, -1) * (x @ v)).sum() + ridge / 2 * ((v - prior) ** 2).sum()
    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        while (then := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if now - then < 1e-9:
            break
        now = then
    w[:-1] = np.maximum(w[:-1], 0)
    return w


def _signal(kinds: np.ndarray) -> np.ndarray:
    return np.minimum(kinds, 6.0)


class Model:
    def __init__(self, stems: dict[str, float], weights: np.ndarray):
        self.stems, self.weights = stems, weights

    def score(self, texts) -> tuple[np.ndarray, np.ndarray]:
        lexicon = Lexicon(self.stems)
        kinds = np.array([clause_kinds(t, lexicon) for t in texts]).reshape(-1, len(KINDS))
        z = _signal(kinds) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), kinds


def spread(text: Column, most: int) -> Column:
    """A text of at most so many characters whole; of a longer one pieces from all over it, a line each."""
    width, n = max(1, most // WINDOWS), F.length(text)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.substr(text, F.floor(k * ((n - width) / F.lit(float(WINDOWS - 1)))).cast("int") + 1, F.lit(width)))
    return F.when(n > most, F.array_join(pieces, "\n")).otherwise(text)


def sampled(docs: DataFrame, labels: DataFrame, column: str, fold: int, held: int, per_class: int, sample_chars: int) -> tuple[list[str], list[int]]:
    """Labelled texts outside the held-out fold: at most about `per_class` of each label, by the hash of the id."""
    known = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (bucket(F.col("doc_id"), fold) != held))
    known = known.groupBy("doc_id").agg((F.max(column) if column == "toxic" else F.min(column)).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, min(1.0, per_class / max(1, counts.get(1, 0)))).otherwise(min(1.0, per_class / max(1, counts.get(0, 0))))
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) < share * 1_000_003).hint("broadcast")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    rows = texts.join(picked, "doc_id").select("doc_id", spread(F.col("text"), sample_chars).alias("text"), "y").orderBy("doc_id", "text").toArrow()
    return rows["text"].to_pylist(), rows["y"].to_pylist()


def train(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, per_class: int = 3000, sample_chars: int = 20_000) -> Model:
    texts, y = sampled(docs, labels, "toxic", fold, held, per_class, sample_chars)
    stems = learn_stems(texts, y)
    lexicon = Lexicon(stems)
    x = np.array([clause_kinds(t, lexicon) for t in texts]).reshape(-1, len(KINDS))
    return Model(stems, fit_weights(_signal(x), np.array(y, float)) if len(texts) else np.append(PRIOR, BIAS))


def _scored(model):
    def run(batches):
        for batch in batches:
            score, kinds = model.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(kinds.sum(1))], ["doc_id", "score", "predicted", "matched"])

    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, matched) of every row; matched: the weighted number of matched clauses."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(K.tidy(_scored(docs.sparkSession.sparkContext.broadcast(model))), f"doc_id {kind}, score double, predicted int, matched double")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose texts score below one half, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = shared.value.score(batch.column(place).to_pylist())[0] < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(K.tidy(run), docs.schema)
