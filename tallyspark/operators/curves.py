"""Acquisition curves: sigmoids fitted to many words at once, and the ages at which they cross a level.

Results of one word at one step are summed up before they are gathered: a fit needs their number and mean only, as what the squares around the mean add
doesn't depend on the curve. So a word's row has as many points as there are checkpoints, however many results; what counts besides are its
least and greatest value, and the steps of the first and the last result in the order of arrival. A task then fits its words in batches: damped Gauss-Newton steps of all words of a batch are the same
few array operations, each word with a damping of its own, until every word is done. No word costs a call of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINTS = 1 << 18  # of a batch, with padding
CHANCE = math.log2(300_000)  # the surprisal of a guess among so many words


def _sigmoid(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logistic part and the value, for words by points."""
    s = 1 / (1 + np.exp(-np.clip(p[:, 1:2] * (x - p[:, 2:3]), -500, 500)))
    return s, p[:, 0:1] * s + p[:, 3:4]


def fit_sigmoids(x: np.ndarray, y: np.ndarray, mask: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200, weight: np.ndarray | None = None) -> np.ndarray:
    """(words, 4): a, b, c, d of a / (1 + exp(-b (x - c))) + d with the least squares over each word's points, within bounds.

    x, y, mask: words by points; start, low, high: words by parameters; weight: how many results a point stands for. A word that can't be fitted is NaN."""
    p = np.clip(start.astype(float), low, high)
    weight = np.where(mask, 1.0 if weight is None else weight, 0.0)
    damp = np.full(len(p), 1e-2)

    def cost(rows, q):
        return (np.where(mask[rows], _sigmoid(x[rows], q)[1] - y[rows], 0.0) ** 2 * weight[rows]).sum(1)

    live = np.arange(len(p))
    now = cost(live, p)
    for _ in range(rounds):
        if not len(live):
            break
        q, m, root = p[live], mask[live], np.sqrt(weight[live])
        s, value = _sigmoid(x[live], q)
        g = q[:, 0:1] * s * (1 - s)
        j = np.stack([s, g * (x[live] - q[:, 2:3]), -g * q[:, 1:2], np.ones_like(s)], 2) * root[:, :, None]
        r = np.where(m, value - y[live], 0.0) * root
        a = np.einsum("wpi,wpj->wij", j, j)
        diagonal = np.einsum("wii->wi", a)
        damped = a + np.eye(4) * (damp[live, None] * (diagonal + 1e-12))[:, None, :]
        right = np.einsum("wpi,wp->wi", j, r)
        sound = np.isfinite(damped).all((1, 2)) & np.isfinite(right).all(1) & (np.abs(np.linalg.det(np.where(np.isfinite(damped), damped, 0.0))) > 0)
        step = np.zeros_like(q)
        if sound.any():
            step[sound] = np.linalg.solve(damped[sound], right[sound][:, :, None])[:, :, 0]
        trial = np.clip(q - step, low[live], high[live])
        then = cost(live, trial)
        better = sound & (then < now[live])
        done = better & (now[live] - then < 1e-14 * (1 + now[live])) | ~sound
        p[live[better]] = trial[better]
        now[live[better]] = then[better]
        damp[live] = np.where(better, np.maximum(damp[live] / 3, 1e-12), damp[live] * 4)
        live = live[~done & (damp[live] <= 1e12)]
    p[~np.isfinite(p).all(1)] = np.nan
    return p


def crossings(p: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Where each curve reaches its level; NaN unless it rises through it."""
    a, b, c, d = p.T
    with np.errstate(invalid="ignore", divide="ignore"):
        rises = (a > 0) & (b > 0) & (d < level) & (level < a + d)
        return np.where(rises, c - np.log(np.where(rises, a / (level - d) - 1, 1.0)) / np.where(rises, b, 1.0), np.nan)


class Told:
    """What points tell of a word: the number of results of each, the first and the last x in order of arrival, the least and the greatest y. From the points, filled from the left, unless given."""

    def __init__(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, weight=None, first=None, last=None, least=None, most=None):
        self.weight = np.where(mask, 1.0 if weight is None else weight, 0.0)
        self.n = self.weight.sum(1)
        self.few = self.n < 3
        self.mean = lambda v: (np.where(mask, v, 0) * self.weight).sum(1) / np.maximum(self.n, 1)
        at = np.maximum(mask.sum(1) - 1, 0)
        end = lambda k: np.where(self.n > 0, x[np.arange(len(x)), k], 0.0) if x.shape[1] else np.zeros(len(x))
        self.first, self.last = end(0 * at) if first is None else first, end(at) if last is None else last
        self.least = np.where(mask, y, np.inf).min(1, initial=np.inf) if least is None else least
        self.most = np.where(mask, y, -np.inf).max(1, initial=-np.inf) if most is None else most


def child_ages(x: np.ndarray, y: np.ndarray, mask: np.ndarray, level: float = 0.5, told: Told | None = None) -> np.ndarray:
    """The ages at which bounded sigmoids through proportions reach a half, within the first and the last age; NaN where there is none."""
    t = told or Told(x, y, mask)
    one = np.ones(len(x))
    start = np.stack([one, 0.1 * one, t.mean(x), 0 * one], 1)
    low, high = np.stack([0 * one, 0 * one, np.minimum(t.first, t.last), -0.5 * one], 1), np.stack([2 * one, one, np.maximum(t.first, t.last), 0.5 * one], 1)
    at = crossings(fit_sigmoids(x, y, mask, start, low, high, weight=t.weight), np.full(len(x), level))
    return np.where(~t.few & (t.first <= at) & (at <= t.last), at, np.nan)


def model_ages(step: np.ndarray, surprisal: np.ndarray, mask: np.ndarray, chance: float = CHANCE, told: Told | None = None) -> np.ndarray:
    """log10 of the steps at which surprisal has gone half the way from chance to its least value, from the first to the last step in order of arrival."""
    t = told or Told(step, surprisal, mask)
    x, y = np.log10(np.where(mask, step, 0) + 1), np.where(mask, -surprisal, 0.0)
    some = t.n > 0
    least, most = np.where(some, -t.most, 0.0), np.where(some, -t.least, 0.0)
    one = np.ones(len(x))
    start = np.stack([most - least, one, t.mean(x), least], 1)
    free = np.full((len(x), 4), np.inf)
    at = crossings(fit_sigmoids(x, y, mask, start, -free, free, weight=t.weight), (most - chance) / 2)
    with np.errstate(over="ignore", invalid="ignore"):
        back = 10**at - 1
        return np.where(~t.few & (t.first <= back) & (back <= t.last), at, np.nan)


KINDS = {"model": model_ages, "child": child_ages}


def child_age(x, y, level: float = 0.5) -> float | None:
    """One word's age; None where there is none."""
    return _one(child_ages, x, y, level)


def model_age(step, surprisal, chance: float = CHANCE) -> float | None:
    return _one(model_ages, step, surprisal, chance)


def _one(f, x, y, more) -> float | None:
    keep = np.isfinite(x) & np.isfinite(y)
    x, y = np.asarray(x, float)[keep][None, :], np.asarray(y, float)[keep][None, :]
    at = float(f(x, y, np.ones(x.shape, bool), more)[0])
    return at if math.isfinite(at) else None


def series(rows: DataFrame, word: str, x: str, y: str, order: list[str]) -> DataFrame:
    """(word, xs, ys, ns, first, last, least, most): each word's distinct xs with the mean and number of their ys; the first and last x in order of arrival. Results that lack a number don't count."""
    number = lambda c: F.nullif(F.col(c).cast("double"), F.lit(float("nan")))
    whole = number(x).isNotNull() & number(y).isNotNull()
    come = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], number(x).alias("x"), number(y).alias("y"))
    each = rows.select(F.col(word).cast("string").alias(word), F.when(whole, number(x)).alias("x"), F.when(whole, number(y)).alias("y"), F.when(whole, come).alias("o"))
    ends = lambda c: [F.min(f"{c}").alias("first"), F.max(f"{c}").alias("last")]
    points = each.groupBy(word, "x").agg(F.avg("y").alias("y"), F.count("y").cast("double").alias("n"), F.min("y").alias("least"), F.max("y").alias("most"), *ends("o"))
    point = F.when(F.col("x").isNotNull(), F.struct("x", "y", "n"))
    found = points.groupBy(word).agg(F.sort_array(F.collect_list(point)).alias("p"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("least").alias("least"), F.max("most").alias("most"))
    return found.select(word, F.col("p.x").alias("xs"), F.col("p.y").alias("ys"), F.col("p.n").alias("ns"), F.col("first.x").alias("first"), F.col("last.x").alias("last"), "least", "most")


def _fitted(kind: str, word: str):
    f = KINDS[kind]

    def batched(sizes: np.ndarray) -> Iterator[np.ndarray]:
        """Words of similar length together, so that little is padded."""
        order, lo = np.argsort(sizes, kind="stable")[::-1], 0
        while lo < len(order):
            hi = lo + max(1, POINTS // max(1, int(sizes[order[lo]])))
            yield order[lo:hi]
            lo = hi

    def run(batches):
        for batch in batches:
            xs, ys, ns = (batch.column(k).combine_chunks() if isinstance(batch.column(k), pa.ChunkedArray) else batch.column(k) for k in (1, 2, 3))
            ends = [np.asarray(batch.column(k).fill_null(0.0), float) for k in range(4, 8)]
            sizes = np.asarray(xs.value_lengths().fill_null(0), np.int64)
            at = np.cumsum(sizes) - sizes
            flat_x, flat_y, flat_n = (np.asarray(v.flatten(), float) for v in (xs, ys, ns))
            out = np.full(batch.num_rows, np.nan)
            for some in batched(sizes):
                mask = np.arange(int(sizes[some].max(initial=0)))[None, :] < sizes[some][:, None]
                place = (at[some][:, None] + np.arange(mask.shape[1])[None, :])[mask]
                x, y, n = np.zeros(mask.shape), np.zeros(mask.shape), np.zeros(mask.shape)
                x[mask], y[mask], n[mask] = flat_x[place], flat_y[place], flat_n[place]
                out[some] = f(x, y, mask, told=Told(x, y, mask, n, *[e[some] for e in ends]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, mask=np.isnan(out))], [word, "age"])

    return run


def ages(rows: DataFrame, word: str, x: str, y: str, kind: str = "model", order: list[str] | None = None) -> DataFrame:
    """(word, age) of every word, null where its curve doesn't cross. order: that of arrival, by which the first and the last point bound the age; by x and y where none is given.

    Several results of one step count as so many."""
    return series(rows, word, x, y, order or [x, y]).mapInArrow(_fitted(kind, word), f"{word} string, age double")


def fitness(model: DataFrame, child: DataFrame, word: str) -> DataFrame:
    """(r, n, p) of the ages of both sides, (word, age), over words that have both; fewer than three give 0."""
    from . import stats

    both = model.filter("age is not null").select(word, F.col("age").alias("m")).join(child.filter("age is not null").select(word, F.col("age").alias("c")), word)
    return stats.pearson_p(stats.pearson(both, F.col("m"), F.col("c"), empty=0.0))
