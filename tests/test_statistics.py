"""Curves, rank correlations, nested fits, lines of big files: against plain versions."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import curves, relate, stats
from tallyspark.sources import readers


def sigmoid(x, p):
    return p[0] / (1 + np.exp(-p[1] * (x - p[2]))) + p[3]


def words(n, seed=1):
    """Noiseless curves of different lengths with their parameters."""
    r = np.random.default_rng(seed)
    x = np.log10(np.array([*range(1, 11), *range(20, 101, 10), *range(200, 1001, 100)]) * 1e6 + 1)
    out = []
    for _ in range(n):
        p = (r.uniform(5, 8), r.uniform(3, 6), r.uniform(6.6, 8.2), r.uniform(-16, -15))
        keep = np.sort(r.choice(len(x), r.integers(20, len(x) + 1), replace=False))
        out.append((10 ** x[keep] - 1, -sigmoid(x[keep], p), p))
    return out


def test_noiseless_curves_give_their_own_ages():
    hit = 0
    for step, s, (a, b, c, d) in words(60):
        level = -(curves.CHANCE + s.min()) / 2
        want = c - math.log(a / (level - d) - 1) / b if d < level < a + d else None
        if want is not None and not step[0] <= 10**want - 1 <= step[-1]:
            want = None
        got = curves.model_age(step, s)
        hit += want is not None
        assert (got is None) == (want is None) and (want is None or abs(got - want) < 1e-6)
    assert hit > 30


def test_a_batch_is_its_words_one_by_one(spark, monkeypatch):
    """Whatever the batches, a word's age is its own; noise, repeated steps and missing values included."""
    r = np.random.default_rng(3)
    rows, want = [], {}
    for k, (step, s, _) in enumerate(words(40, 2)):
        s = s + r.normal(0, 0.3, len(s))
        step, s = np.repeat(step, 2), np.repeat(s, 2) + r.normal(0, 0.1, 2 * len(s))
        s[r.integers(len(s))] = np.nan
        rows += [(f"w{k}", j, float(a), float(b)) for j, (a, b) in enumerate(zip(step, s))]
        want[f"w{k}"] = curves.model_age(step, s)
    rows += [("few", 0, 1e6, 9.0), ("few", 1, 2e6, 8.0), ("none", 0, 1e6, None), ("flat", 0, 1e6, 5.0), ("flat", 1, 2e6, 5.0), ("flat", 2, 3e6, 5.0), (None, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "word string, n int, step double, s double").repartition(7)
    for points in (64, 1 << 18):
        monkeypatch.setattr(curves, "POINTS", points)
        got = {x.word: x.age for x in stats.ages(df, "word", "step", "s", order=["n"]).collect()}
        assert set(got) == {*want, "few", "none", "flat", None} and [got[k] for k in ("few", "none", "flat", None)] == [None] * 4
        assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-5) for k, v in want.items())
    assert sum(v is not None for v in want.values()) > 15


def test_arrival_bounds_the_age(spark):
    """The first and the last point in order of arrival say what ages are within reach, not the least and the greatest step."""
    step, s, _ = words(1, 5)[0]
    late = np.append(step[1:], step[0])  # the first checkpoint came last
    rows = [("in order", k, float(a), float(b)) for k, (a, b) in enumerate(zip(step, s))] + [("late", k, float(a), float(b)) for k, (a, b) in enumerate(zip(late, np.append(s[1:], s[0])))]
    got = {x.word: x.age for x in stats.ages(spark.createDataFrame(rows, "word string, n int, step double, s double"), "word", "step", "s", order=["n"]).collect()}
    assert got["in order"] is not None and got["late"] is None


def test_results_of_a_step_are_summed_up(spark):
    """A word with many results at few steps is a row of few points, and its age that of all results."""
    r = np.random.default_rng(6)
    step, s, _ = words(3, 8)[2]
    x, y = np.repeat(step, 500), np.repeat(s, 500) + r.normal(0, 0.2, 500 * len(s))
    rows = [("w", k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))] + [("w", -1, None, 1.0), ("w", 10**6, 5.0, None)]
    df = spark.createDataFrame(rows, "word string, n int, step double, s double").repartition(5)
    made = curves.series(df, "word", "step", "s", ["n"]).first()
    assert len(made.xs) == len(step) and made.ns == [500.0] * len(step) and (made.first, made.last) == (x[0], x[-1])
    got, want = stats.ages(df, "word", "step", "s", order=["n"]).first().age, curves.model_age(x, y)
    assert (got is None) == (want is None) and (want is None or abs(got - want) < 1e-6)


def test_many_words(spark):
    base = words(200, 7)
    n = 20_000
    x = np.zeros((n, 28))
    y, mask = x.copy(), np.zeros(x.shape, bool)
    for k in range(n):
        step, s, _ = base[k % 200]
        x[k, : len(step)], y[k, : len(step)], mask[k, : len(step)] = step, s, True
    start = time.process_time()
    got = curves.model_ages(x, y, mask)
    assert time.process_time() - start < 120
    ones = np.array([curves.model_age(*w[:2]) or np.nan for w in base])
    assert np.allclose(got, np.tile(ones, n // 200), atol=1e-6, equal_nan=True)


def test_fitness(spark):
    m = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.5), ("d", None), ("e", 2.0)], "w string, age double")
    c = spark.createDataFrame([("a", 18.0), ("b", 20.0), ("c", 22.0), ("d", 3.0), ("e", None)], "w string, age double")
    r = curves.fitness(m, c, "w").first()
    assert r.n == 3 and abs(r.r - np.corrcoef([1, 2, 3.5], [18, 20, 22])[0, 1]) < 1e-12
    few = curves.fitness(m.filter("w < 'c'"), c, "w").first()
    assert (few.r, few.n, few.p) == (0.0, 2, 1.0)


def plain_ranks(v):
    v = np.array(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


@pytest.mark.parametrize("digits", [1, 6])
def test_rank_correlation_of_matrices(spark, digits):
    r = np.random.default_rng(8)
    rows = [(k - 20, r.normal(size=6).tolist(), r.normal(size=3).tolist()) for k in range(50)]
    rows = [(k, a, (np.array(a[:3]) + 0.5 * np.array(b)).tolist()) for k, a, b in rows]
    rows += [(40, rows[0][1], rows[0][2]), (41, [0.0] * 6, [1.0] * 3), (42, None, [1.0] * 3), (43, [1.0] * 6, [math.nan, 1.0, 1.0]), (None, [1.0] * 6, [1.0] * 3)]
    good = [x for x in rows if x[0] is not None and x[0] < 41]
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    pairs = [(i, j) for i in range(len(good)) for j in range(i)]
    rounded = lambda k: [math.copysign(math.floor(abs(c) * 10**digits + 0.5), c) for i, j in pairs for c in [unit(good[i][k]) @ unit(good[j][k])]]
    want = np.corrcoef(plain_ranks(rounded(1)), plain_ranks(rounded(2)))[0, 1]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>").repartition(3)
    for block in (7, 1024):
        got = stats.matrix_rank_correlation(df, "id", "a", "b", digits, block).first()
        assert got.n == len(pairs) and abs(got.rho - want) < 1e-9
    assert stats.matrix_rank_correlation(df.filter("id is null"), "id", "a", "b").first().rho is None
    same = spark.createDataFrame([(k, [1.0, 2.0], [float(k), 1.0]) for k in range(4)], "id long, a array<double>, b array<double>")
    assert stats.matrix_rank_correlation(same, "id", "a", "b").first().rho is None  # one of them is constant


def test_blocks_of_sparse_keys(spark):
    """Keys far apart make no more blocks than dense ones, and single numbers move as such: what the blocks of all pairs hold is a few times the input."""
    r = np.random.default_rng(4)
    rows = [(int(k) * 1_000_003 - 7, r.normal(size=5).tolist()) for k in r.permutation(300)] + [(-50, [0.0] * 5), (-51, [1.0, None, 0.0, 0.0, 0.0]), (-52, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    moved = stats._blocks_of(df, "id", 100, ["v"])
    assert moved.count() <= 6 * len(rows) and moved.schema["v"].dataType.simpleString() == "array<float>"
    unit = {k: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for k, v in rows if v and None not in v and any(v)}
    for block in (None, 100, 7):
        got = {x.i: x for x in stats.cosine_summary(df, "id", "v", block).collect()}
        assert len(got) == len(rows) - 1 and all(x.n == sum(j < i for j, _ in rows) for i, x in got.items())
        for i in got:
            below = [unit[i] @ unit[j] for j in unit if j < i] if i in unit else []
            assert (got[i].nearest is None) == (not below) and (not below or abs(got[i].nearest - max(below)) < 1e-9 and abs(got[i].mean - np.mean(below)) < 1e-9)


def test_average_ranks_keep_rows(spark):
    df = spark.createDataFrame([("a", 3.0, 1), ("a", None, 2), ("a", 1.0, 3), ("a", 3.0, 4), (None, 5.0, 5), (None, math.nan, 6), (None, 4.0, 7)], "g string, x double, id int")
    assert {r.id: r.rank for r in stats.average_ranks(df, "x", "rank", ["g"]).collect()} == {1: 2.5, 2: None, 3: 1.0, 4: 2.5, 5: 2.0, 6: None, 7: 1.0}
    assert {r.id: r.rank for r in stats.average_ranks(df, "x", "rank").collect()} == {1: 2.5, 2: None, 3: 1.0, 4: 2.5, 5: 5.0, 6: None, 7: 4.0}


def test_nested_fits_of_all_measures(spark):
    """Each measure against least squares by numpy on the rows that are complete for it, with and without the prediction."""
    r = np.random.default_rng(9)
    n = 400
    a, b, p = r.normal(50, 5, n), r.normal(size=n), r.normal(1e3, 1, n)
    columns = {f"m{k}": a * k + b - p / (k + 1) + r.normal(size=n) for k in range(4)}
    lost = {c: r.random(n) < 0.2 for c in [*columns, "p", "a"]}
    rows = [tuple([None if lost["a"][i] else float(a[i]), float(b[i]), (math.nan if i % 2 else None) if lost["p"][i] else float(p[i])] + [None if lost[c][i] else float(v[i]) for c, v in columns.items()] + [None]) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, p double, " + ", ".join(f"{c} double" for c in columns) + ", nothing double").repartition(3)
    got = stats.nested_fits(df, [*columns, "nothing"], ["a", "b"], "p")
    for c, y in columns.items():
        for fit, extra in zip(got[c], ([], [p])):
            keep = ~lost[c] & ~lost["a"] & (~lost["p"] if extra else True)
            x = np.column_stack([np.ones(n), a, b, *extra])[keep]
            coef, rss = np.linalg.lstsq(x, y[keep], rcond=None)[:2]
            assert fit["n"] == keep.sum() and np.allclose(fit["coef"], coef, rtol=1e-5, atol=1e-6)
            assert abs(fit["r2"] - (1 - rss[0] / ((y[keep] - y[keep].mean()) ** 2).sum())) < 1e-9
            assert abs(fit["aic"] - (keep.sum() * (math.log(2 * math.pi * rss[0] / keep.sum()) + 1) + 2 * x.shape[1])) < 1e-6
    assert [f["n"] for f in got["nothing"]] == [0, 0]
    assert [f["n"] for f in stats.nested_fits(df.filter("false"), ["m0"], ["a"], "p")["m0"]] == [0, 0]


def test_beta_against_a_scan(spark):
    r = np.random.default_rng(10)
    logits, human = r.normal(size=(30, 8)), r.dirichlet(np.ones(8), 30)
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(logits, human)], "l array<double>, h array<double>")

    def divergence(beta):
        e = np.exp(beta * (logits - logits.max(1, keepdims=True)))
        q = np.clip(e / e.sum(1, keepdims=True), 1e-10, 1)
        return float((human * np.log(human / q)).sum(1).mean())

    grid = np.geomspace(0.025, 40, 20_000)
    best = min(grid, key=divergence)
    got = stats.best_beta(df, "h", "l")
    assert abs(got["beta"] / best - 1) < 2e-3 and got["kl"] <= divergence(best) + 1e-8
    assert stats.best_beta(df, "h", "l", grid=[0.5, 1.0, 30.0])["beta"] == min((0.5, 1.0, 30.0), key=divergence)


def test_divergences_are_those_of_the_expressions(spark):
    """Nulls, missing mates, NaN and infinite logits count as in `kl` of `softmax`; a pass gives a row of sums, no expression of arrays is left in it."""
    nan, inf = math.nan, math.inf
    rows = [([0.2, 0.8], [1.0, 2.0]), ([0.5, None], [1.0, 2.0]), ([0.5, 0.5], [None, 2.0]), ([0.1, 0.2, 0.7], [3.0, 1.0]), ([1.0], [4.0, -2.0, 900.0]), ([nan, 0.5], [1.0, 0.0])]
    rows += [([0.5, 0.5], [nan, 1.0]), ([0.5, 0.5], [inf, 1.0]), (None, [1.0]), ([1.0], None), ([], []), ([1.0], []), ([], [1.0]), ([0.0, 1.0], [0.0, 1000.0]), ([None], [None])]
    df = spark.createDataFrame(rows, "h array<double>, l array<double>").repartition(3)
    for beta in (0.025, 1.0, 40.0):
        want = df.agg(F.avg(stats.kl(F.col("h"), stats.softmax(F.col("l"), beta)))).first()[0]
        assert abs(stats.best_beta(df, "h", "l", grid=[beta])["kl"] - want) < 1e-9
    assert stats.best_beta(df.filter("h is null"), "h", "l", grid=[1.0])["kl"] is None


def test_languages_of_models(spark):
    names = ["GPT-Strict-Small", "x-lm-zho", "en_nld_equal", "nld_zho_equal", "en_nld_zho_equal", "english", "gpt", "zho", None]
    got = {r.m: (r.languages, r.place) for r in relate.by_languages(spark.createDataFrame([(n,) for n in names], "m string"), "m").collect()}
    assert got == {"GPT-Strict-Small": (["eng"], 0), "x-lm-zho": (["zho"], 2), "en_nld_equal": (["eng", "nld"], 3), "nld_zho_equal": (["nld", "zho"], 5), "en_nld_zho_equal": (["eng", "nld", "zho"], 6), "english": (["eng"], 0), "gpt": ([], 7), "zho": (["zho"], 2), None: ([], 7)}


@pytest.mark.parametrize("size", [64, 1000, 1 << 27])
def test_numbered_lines(spark, tmp_path, size):
    """Numbers are those of the file, however many splits it is read in."""
    r = np.random.default_rng(11)
    want = {}
    for name, n in (("a", 300), ("b", 1), ("c", 0), ("d", 40)):
        lines = ["" if r.random() < 0.1 else f"{name}{k} " + "é" * int(r.integers(0, 40 if k % 50 else 3000)) for k in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + ("" if name == "d" else "\n") * (n > 0), encoding="utf-8")
        while name == "d" and lines and not lines[-1]:
            lines.pop()
        want |= {(name, k): x for k, x in enumerate(lines)}
    (tmp_path / "other.txt").write_text("no\n")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, (str(size), "1")):
            spark.conf.set(k, v)
        got = readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(x.stem, x.line_no): x.line for x in got} == want and len(got) == len(want)
