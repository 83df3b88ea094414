"""Sentence segmentation: abbreviations learned from a corpus, measured against labelled sentences."""

from __future__ import annotations

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import sentences, text

ABBREVIATIONS = ["dr", "mr", "prof", "approx", "e.g", "i.e", "vol", "fig", "st", "inc"]
NAMES = ["Smith", "Garcia", "Ito", "Okafor", "Novak"]
WORDS = "the a of and river stone light people walk found paper after under house morning green small seven clear answer number table winter question music".split()


def sentence(r):
    w = [r.choice(WORDS) for _ in range(r.randrange(4, 12))]
    if r.random() < 0.5:
        k = r.randrange(1, len(w))
        a = r.choice(ABBREVIATIONS)
        w[k:k] = [a.capitalize() + "."] + [r.choice(NAMES)] if a in ("dr", "mr", "prof", "st") else [a + "."]
    if r.random() < 0.1:
        w[1:1] = [r.choice("JKLM") + ".", r.choice(NAMES)]
    if r.random() < 0.1:
        w.append(r.choice(["12", "1999"]))
    w[0] = w[0].capitalize()
    return " ".join(w) + r.choice([".", ".", ".", "!", "?", '."'])


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    docs = [[sentence(r) for _ in range(r.randrange(1, 12))] for _ in range(400)]
    return docs, spark.createDataFrame([(k, (" " if k % 3 else "\n\n").join(d), 7) for k, d in enumerate(docs)], "id long, body string, extra int").repartition(5)


def scores(found, docs):
    """F1 of boundaries by their places in the words of a text."""
    hit = made = there = 0
    for got, want in zip(found, docs):
        ends = lambda x: {sum(len(s.split()) for s in x[: k + 1]) for k in range(len(x) - 1)}
        a, b = ends(got), ends(want)
        hit, made, there = hit + len(a & b), made + len(a), there + len(b)
    return 2 * hit / (made + there)


def test_learned_boundaries(corpus):
    docs, df = corpus
    known = sentences.abbreviations(df, F.col("body"))
    found = {r.word for r in known.collect()}
    assert found >= set(ABBREVIATIONS) - {"approx"} and not found & set(WORDS)
    rows = sentences.split(df, ["id"], "body", known, sentences.starters(df, F.col("body"))).collect()
    got = [r.sentences for r in sorted(rows, key=lambda r: r.id)]
    fixed = [r.s for r in sorted(df.select("id", text.sentences(F.col("body")).alias("s")).collect(), key=lambda r: r.id)]
    learned, plain = scores(got, docs), scores(fixed, docs)
    assert learned > 0.97 and plain < 0.85, (learned, plain)
    assert all(" ".join(g) == " ".join(" ".join(d).split()) for g, d in zip(got, docs))  # nothing is lost


def test_scores_by_their_formula(spark, corpus):
    docs, df = corpus
    counts = collections.defaultdict(lambda: [0, 0])
    for d in docs:
        for t in " ".join(d).lower().split():
            t = t.rstrip('"')
            if t.endswith("."):
                word, k = t[:-1], 0
            else:
                word, k = t.rstrip("!?"), 1
            if word and all(c.isalpha() or c == "." for c in word) and word[-1].isalpha():
                counts[word][k] += 1
    p = sum(a for a, _ in counts.values()) / sum(a + o for a, o in counts.values())
    got = {r.word: (r.with_stop, r.without, r.score) for r in sentences.scored(sentences.word_counts(df, F.col("body"))).collect()}
    assert set(got) == {w for w, (a, _) in counts.items() if a}
    for w, (a, o, s) in got.items():
        n = len(w.replace(".", ""))
        ratio = -2 * (a * math.log(p) + o * math.log(1 - p) - a * math.log(0.99) - o * math.log(0.01))
        assert (a, o) == tuple(counts[w]) and abs(s - ratio * math.exp(-n) * (w.count(".") + 1) * n ** -o) < 1e-9 * max(1, abs(s))


def test_odd_texts(spark):
    known, begin = (spark.createDataFrame([(w,) for w in x], "word string") for x in (["dr", "e.g"], ["the", "we"]))
    said = {
        "Dr. Smith came. The end": ["Dr. Smith came.", "The end"],
        "Ask the dr. The other one left.": ["Ask the dr.", "The other one left."],
        "Some, e.g. this one. We go.": ["Some, e.g. this one.", "We go."],
        "J. K. Ito wrote. (We read.) Well…": ["J. K. Ito wrote.", "(We read.)", "Well…"],
        "It was in 12. we think.": ["It was in 12. we think."],
        "no mark": ["no mark"],
        "": [],
        " \n ": [],
        "...": ["..."],
        "a.b.c": ["a.b.c"],
        "He is a dr.": ["He is a dr."],
        None: None,
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(said)] + [(None, "The dr. and we. The end.")], "id int, t string")
    got = {r.t: r.s for r in sentences.split(df, ["id"], "t", known, begin, "s").collect()}
    assert got == said | {"The dr. and we. The end.": ["The dr. and we.", "The end."]}
    none = spark.createDataFrame([], "word string")
    assert sentences.split(df.filter("id is null"), ["id"], "t", none, none, "s").first().s == ["The dr.", "and we.", "The end."]
    empty = df.filter("false")
    assert sentences.abbreviations(empty, F.col("t")).count() == 0 and sentences.split(empty, ["id"], "t", known, begin).count() == 0
