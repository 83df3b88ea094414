"""Statistics: correlations, regressions by moments, classification metrics, choice models, curve fits.

Whatever can be is an aggregation of products, so one pass with map-side sums serves any number of rows, and only
k x k moments reach the driver. Curve fits, which iterate, run in numpy on batches of words (curves).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .curves import ages, child_age, model_age  # noqa: F401  (fits are part of the statistics)
from .ordinals import cuts


def pearson(rows: DataFrame, a: Column, b: Column, by: list[str] = (), least: int = 2, empty: float | None = None) -> DataFrame:
    """r over complete pairs; `empty` where a column is constant or there are too few pairs. Centred in a second pass over means for precision."""
    x, y = a.cast("double"), b.cast("double")
    ok = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    pairs = rows.select(*by, F.when(ok, x).alias("x"), F.when(ok, y).alias("y"))
    r = F.when((F.count("x") >= least) & (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0), F.covar_pop("x", "y") / (F.stddev_pop("x") * F.stddev_pop("y"))).otherwise(F.lit(empty).cast("double"))
    return pairs.groupBy(*by).agg(r.alias("r"), F.count("x").alias("n"))


def pearson_p(found: DataFrame, least: int = 3) -> DataFrame:
    """`found` (r, n) with p, the two-sided probability of such an r by chance; below `least` pairs, r is 0 and p is 1."""

    def p_of(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([1.0 if r_ is None or math.isnan(r_) or n_ < least else 0.0 if abs(r_) >= 1 else _t_tail(r_ * math.sqrt((n_ - 2) / (1 - r_ * r_)), n_ - 2) for r_, n_ in zip(r, n)])

    p = F.pandas_udf(p_of, "double")(F.col("r"), F.col("n"))  # a row a correlation
    few = F.col("n") < least
    return found.withColumn("p", p).withColumn("r", F.when(few, F.lit(0.0)).otherwise(F.col("r")))


def running_total(rows: DataFrame, order: list[str], amount: str, out: str, by: list[str] = (), parts: int = 64) -> DataFrame:
    """`out`: the sum of `amount` over all rows up to each one. order: total, its first column a number.

    Groups are cut into ranges of the first column at its quantiles, found in one pass; each range is summed on its own, and adds the
    totals of the ranges before it. So a single group, the whole table too, is sorted by many tasks."""
    first = order[0]
    cuts = rows.agg(F.percentile_approx(F.col(first).cast("double"), [k / parts for k in range(1, parts)], 1000).alias("c")).first()["c"] or []
    cuts = sorted({c for c in cuts if c is not None and not math.isnan(c)})
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(first).cast("double"))) if cuts else F.lit(0)
    cut = rows.withColumn("__range", at)
    totals = cut.groupBy(*by, "__range").agg(F.sum(amount).alias("__t"))
    before = F.sum("__t").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # `parts` rows a group
    totals = totals.select(*by, "__range", F.coalesce(before, F.lit(0)).alias("__before"))
    w = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = totals.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__at"), "__before")
    on = F.col("__range") == F.col("__at")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return cut.withColumn("__sum", F.sum(amount).over(w)).join(before if by else F.broadcast(before), on).select(*rows.columns, (F.col("__sum") + F.col("__before")).alias(out))


def average_ranks(rows: DataFrame, value: str, out: str, by: list[str] = ()) -> DataFrame:
    """Ranks with ties shared evenly; a null or NaN has no rank, and its row stays. Counts by value first, so the ordered pass sees each distinct value once, range by range."""
    number = F.nullif(F.col(value).cast("double"), F.lit(float("nan")))
    counts = rows.withColumn("__v", number).filter("__v is not null").groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    ranks = running_total(counts, ["__v"], "__c", "__r", by).select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__v").alias("__at"), (F.col("__r") - (F.col("__c") - 1) / 2.0).alias(out))
    on = F.col("__v") == F.col("__at")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return rows.withColumn("__v", number).join(ranks, on, "left").select(*rows.columns, out)


def residual(rows: DataFrame, y: str, on: list[str], out: str) -> DataFrame:
    """y without what a least-squares fit on an intercept and `on` explains."""
    coef = ols(rows, y, on)["coef"]
    fitted = F.lit(float(coef[0]))
    for c, b in zip(on, coef[1:]):
        fitted = fitted + F.lit(float(b)) * F.col(c)
    return rows.withColumn(out, F.col(y) - fitted)


def moments(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, centred cross products and the number of complete rows."""
    whole = rows.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).dropna()
    k = len(columns)
    first = whole.agg(F.count("*").alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)]).first()
    mean = np.array([first[f"m{i}"] or 0.0 for i in range(k)])
    away = [F.col(f"c{i}") - float(mean[i]) for i in range(k)]
    second = whole.agg(*[F.sum(away[i] * away[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    cross = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cross[i, j] = cross[j, i] = second[f"s{i}_{j}"] or 0.0
    return mean, cross, first["n"]


def _t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t by the regularised incomplete beta function (continued fraction)."""
    if not math.isfinite(t) or df <= 0:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    out = front * h
    return 1 - out if flip else out


def ols(rows: DataFrame, y: str, on: list[str]) -> dict:
    """Least squares with an intercept: coef, t, p (intercept first), r2, aic, n."""
    return fit(*moments(rows, [*on, y]))


def fit(mean: np.ndarray, cross: np.ndarray, n: int) -> dict:
    """The same from moments, the last column being y."""
    k = len(mean) - 1
    inverse = np.linalg.pinv(cross[:k, :k])
    slope = inverse @ cross[:k, k]
    coef = np.append(mean[k] - slope @ mean[:k], slope)
    rss = max(0.0, cross[k, k] - slope @ cross[:k, k])
    df = n - k - 1
    s2 = rss / df if df > 0 else float("nan")
    se = np.sqrt(np.append(s2 * (1 / max(1, n) + mean[:k] @ inverse @ mean[:k]), s2 * np.diag(inverse)))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = coef / se
    r2 = 1 - rss / cross[k, k] if cross[k, k] > 0 else 0.0
    likelihood = -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1) if rss > 0 and n else float("inf")
    return {"coef": coef, "t": t, "p": np.array([_t_tail(float(x), df) for x in t]), "r2": float(r2), "aic": 2 * (k + 1) - 2 * likelihood, "n": n}


def nested_fits(rows: DataFrame, measures: list[str], on: list[str], added: str) -> dict[str, tuple[dict, dict]]:
    """For each measure the fit on `on`, and that with `added` behind them, each on the rows that are complete for it.

    Two passes, however many measures there are: means, then products of deviations from them, by measure. Rows that lack only
    `added` have sums of their own, so the first fit takes both sums and the second one of them. Only k x k moments of a measure reach the driver."""
    number = lambda c: F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan")))
    names = [f"c{i}" for i in range(len(on))]
    wide = rows.select(*[number(c).alias(n) for n, c in zip(names, on)], number(added).alias("a"), *[number(m).alias(f"y{j}") for j, m in enumerate(measures)]).dropna(subset=names)
    ys = [f"y{j}" for j in range(len(measures))]
    means = wide.agg(*[F.avg(c).alias(c) for c in [*names, "a", *ys]]).first()  # any shift near the mean keeps the digits
    middle = {c: float(means[c] or 0.0) for c in [*names, "a", *ys]}
    each = F.array(*[F.struct(F.lit(m).alias("measure"), (F.col(y) - F.lit(middle[y])).alias("y")) for m, y in zip(measures, ys)])
    long = wide.select(*[(F.col(c) - F.lit(middle[c])).alias(c) for c in names], (F.col("a") - F.lit(middle["a"])).alias("a"), F.inline(F.filter(each, lambda e: e["y"].isNotNull())))
    columns = [*names, "a", "y"]
    k = len(columns)
    centres = {m: [*[middle[c] for c in names], middle["a"], middle[y]] for m, y in zip(measures, ys)}
    away = long.select("measure", F.col("a").isNotNull().alias("whole"), *[F.coalesce(c, F.lit(0.0)).alias(f"d{i}") for i, c in enumerate(columns)])
    sums = [F.sum(f"d{i}").alias(f"s{i}") for i in range(k)] + [F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    found: dict[str, dict[bool, tuple]] = {m: {} for m in measures}
    for r in away.groupBy("measure", "whole").agg(F.count("*").alias("n"), *sums).collect():  # two rows a measure
        cross = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        found[r["measure"]][r["whole"]] = (r["n"], np.array([r[f"s{i}"] for i in range(k)]), cross)
    none = (0, np.zeros(k), np.zeros((k, k)))
    base, out = [i for i in range(k) if i != k - 2], {}
    for m in measures:
        whole, part = found[m].get(True, none), found[m].get(False, none)
        both = tuple(a + b for a, b in zip(whole, part))
        c = np.array(centres[m])

        def fitted(sums: tuple, keep: list[int]) -> dict:
            n, first, cross = sums[0], sums[1][keep], sums[2][np.ix_(keep, keep)]
            return fit(c[keep] + first / max(1, n), cross - np.outer(first, first) / max(1, n), n)

        out[m] = fitted(both, base), fitted(whole, list(range(k)))
    return out


def with_interactions(rows: DataFrame, mains: list[str]) -> tuple[DataFrame, list[str]]:
    """The main effects and all their pairwise products."""
    pairs = [(a, b) for i, a in enumerate(mains) for b in mains[i + 1 :]]
    names = [f"{a}__{b}" for a, b in pairs]
    return rows.withColumns({n: F.col(a) * F.col(b) for n, (a, b) in zip(names, pairs)}), [*mains, *names]


def partial_r2(rows: DataFrame, y: str, baseline: list[str], added: str) -> float:
    """(R2 of the full model - R2 of the baseline) / (1 - R2 of the baseline), on the rows complete for both."""
    whole = rows.dropna(subset=[y, *baseline, added])
    base, full = ols(whole, y, baseline)["r2"], ols(whole, y, [*baseline, added])["r2"]
    return (full - base) / (1 - base) if base < 1 else 0.0


def confusion(rows: DataFrame, gold: Column, guess: Column, by: list[str] = ()) -> DataFrame:
    """accuracy, f1 (of class 1) and mcc; 0 where a denominator is."""
    n = lambda g, p: F.sum(((gold == g) & (guess == p)).cast("long"))
    c = rows.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    d = {k: F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn")}
    product = (d["tp"] + d["fp"]) * (d["tp"] + d["fn"]) * (d["tn"] + d["fp"]) * (d["tn"] + d["fn"])
    return c.withColumns({"accuracy": ratio(d["tp"] + d["tn"], d["tp"] + d["fp"] + d["fn"] + d["tn"], 0.0), "f1": ratio(2 * d["tp"], 2 * d["tp"] + d["fp"] + d["fn"], 0.0), "mcc": ratio(d["tp"] * d["tn"] - d["fp"] * d["fn"], F.sqrt(product), 0.0)})


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` computed once: inside a higher-order function an outer expression would run for every element."""
    return F.transform(F.array(value), use)[0]


def softmax(values: Column, beta: float | Column = 1.0) -> Column:
    """exp(beta (x - max)) over its sum; linear in the number of values."""
    b = beta if isinstance(beta, Column) else F.lit(float(beta))
    powers = _once(F.struct(values.alias("v"), F.array_max(values).cast("double").alias("m")), lambda s: F.transform(s["v"], lambda x: F.exp(b * (x.cast("double") - s["m"]))))
    whole = lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, y: a + y).alias("t"))
    return _once(powers, lambda e: _once(whole(e), lambda s: F.transform(s["e"], lambda x: x / s["t"])))


def kl(p: Column, q: Column, least: float = 1e-10) -> Column:
    """The divergence of q from p, both clipped to [least, 1]."""
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(least), x.cast("double")))
    return F.aggregate(F.zip_with(p, q, lambda a, b: clip(a) * F.ln(clip(a) / clip(b))), F.lit(0.0), lambda a, x: a + x)


LEAST_SHARE = 1e-10


def _padded(column: pa.ListArray, width: int, fill: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists as rows of `width` numbers, `fill` where a list has none; which numbers are there, and the sizes."""
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    m, there = np.full((len(sizes), width), fill), np.arange(width)[None, :] < sizes[:, None]
    flat = column.flatten()
    m[there] = np.where(np.asarray(flat.is_null()), fill, np.asarray(flat.to_numpy(zero_copy_only=False), float))
    there[there] = np.asarray(flat.is_valid())
    return m, there, sizes


def divergences(human: pa.ListArray, logits: pa.ListArray, grid: list[float]) -> tuple[np.ndarray, int]:
    """For each beta the sum over rows of kl(human, softmax(logits, beta)), and the number of rows that have both. As the expressions do: what is null or lacks a mate counts as the least share, a
    null among the logits makes all shares null, NaN is above every number."""
    both = pc.and_(human.is_valid(), logits.is_valid())
    human, logits = human.filter(both), logits.filter(both)
    if not len(human):
        return np.zeros(len(grid)), 0
    sizes = [np.asarray(x.value_lengths(), np.int64) for x in (human, logits)]
    width = int(max(sizes[0].max(), sizes[1].max()))
    p, _, _ = _padded(human, width, LEAST_SHARE)
    x, there, n = _padded(logits, width, -np.inf)
    inside = np.arange(width)[None, :] < np.maximum(*sizes)[:, None]
    p = np.where(inside, np.where(np.isnan(p), 1.0, np.clip(p, LEAST_SHARE, 1.0)), 1.0)
    own = float((p * np.log(p)).sum())
    p = np.where(inside, p, 0.0)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        away = np.where(there, x - np.where(np.isnan(x).any(1), np.nan, x.max(1, initial=-np.inf))[:, None], -np.inf)
        broken = there.sum(1) < n
        out = []
        for beta in grid:
            z = np.where(there, beta * away, -np.inf)
            log_q = z - np.log(np.exp(z).sum(1))[:, None]
            log_q = np.where(there, np.where(np.isnan(log_q), 0.0, np.clip(log_q, math.log(LEAST_SHARE), 0.0)), math.log(LEAST_SHARE))
            log_q[broken] = math.log(LEAST_SHARE)
            out.append(own - float((p * log_q).sum()))
    return np.array(out), len(human)


def best_beta(trials: DataFrame, human: str, logits: str, low: float = 0.025, high: float = 40.0, points: int = 25, rounds: int = 4, grid: list[float] | None = None) -> dict:
    """The inverse temperature with the least mean divergence: the best of a given grid, or of a geometric one that is refined around its best point. Each round is one pass,
    in which a batch of trials is array operations and gives one row of sums: expressions of arrays would run term by term, for each point of the grid anew."""
    best, given = {"beta": low, "kl": float("inf")}, grid
    numbers = lambda c: F.col(c).cast("array<double>").alias(c)
    rows = trials.select(numbers(human), numbers(logits)) if human != logits else trials.select(numbers(human), F.col(logits).cast("array<double>").alias("__logits"))
    for _ in range(1 if given else rounds):
        grid = given or [float(x) for x in np.geomspace(low, high, points)]
        points = len(grid)

        def summed(batches, grid=grid):
            total, n = np.zeros(len(grid)), 0
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    found, many = divergences(part.column(0), part.column(1), grid)
                    total, n = total + found, n + many
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(grid)), pa.int32()), "total": total, "n": pa.array([n] * len(grid), pa.int64())})

        sums = rows.mapInArrow(summed, "k int, total double, n long").groupBy("k").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # a row a point
        scored = {r.k: r.total / r.n for r in sums if r.n}
        k = min(range(points), key=lambda i: (scored.get(i, float("inf")), i))
        best = {"beta": grid[k], "kl": scored.get(k)}
        low, high = grid[max(0, k - 1)], grid[min(points - 1, k + 1)]
    return best


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Rows of a block where the caller names no other size: as many as make BLOCKS blocks, between these bounds.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 1024, 65_536, 24
TILE = (256, 1024)  # rows of two blocks that are multiplied at once: 2 MB of products, which a core's cache holds


def _blocks_of(rows: DataFrame, key: str, block: int | None, values: list[str]) -> DataFrame:
    """(p, q, role, k, values): every row for each pair of blocks p >= q that it belongs to; role 0 in p, 1 in q.

    A block is a range of keys between quantiles of them, so it doesn't matter how dense they are; rows of one key share a block. Without a given size
    there are BLOCKS blocks, so each row moves that often, until a block would have more than MOST_BLOCK rows."""
    unit = rows.select(F.col(key).cast("long").alias("k"), *values).filter("k is not null")
    n = unit.count()
    size = block or max(LEAST_BLOCK, min(MOST_BLOCK, -(-n // BLOCKS)))
    parts = max(1, -(-n // size))
    found = cuts(unit, "k", parts) if parts > 1 else []
    at = F.size(F.filter(F.array(*map(F.lit, found)), lambda c: c < F.col("k").cast("double"))) if found else F.lit(0)
    pair = lambda p, q, role: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), F.lit(role).alias("role"))
    left = F.transform(F.sequence(F.lit(0), F.col("b")), lambda q: pair(F.col("b"), q, 0))
    right = F.transform(F.sequence(F.col("b"), F.lit(len(found))), lambda p: pair(p, F.col("b"), 1))
    return unit.withColumn("b", at).select(F.inline(F.concat(left, right)), "k", *values)


def _numbers(rows: DataFrame, vector: str) -> Column:
    """A column of vectors as numbers: single ones stay so, which halves what moves."""
    kind = rows.schema[vector].dataType.simpleString()
    return F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors at length 1, NaN where one is null, of zero length or lacks a number."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    widths = np.unique(sizes[sizes >= 0])
    if len(widths) > 1:
        raise ValueError("vectors of different lengths")
    m = np.full((len(sizes), int(widths[0]) if len(widths) else 0), np.nan)
    if m.size:
        m[sizes >= 0] = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, m.shape[1])
    if not m.shape[1]:
        return np.full((len(sizes), 1), np.nan)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, np.nan)


def _sides(table: pa.Table, values: list[str]) -> list[tuple[np.ndarray, ...]]:
    """Of a pair of blocks, for each of them: keys in order, and the unit vectors of each column."""
    out = []
    for role in (0, 1):
        part = table.filter(pc.equal(table["role"], role))
        k = part["k"].to_numpy()
        order = np.argsort(k, kind="stable")
        out.append((k[order], *[_units(part[v])[order] for v in values]))
    return out


def _sound(side: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Without the rows of which a vector is NaN or not finite."""
    good = np.logical_and.reduce([np.isfinite(m).all(1) for m in side[1:]])
    return tuple(x[good] for x in side)


def _tiles(i: np.ndarray, j: np.ndarray):
    """(rows of the first, rows of the second, mask) of the tiles with a pair i > j; keys in order. mask: None where all pairs are."""
    for lo in range(0, len(i), TILE[0]):
        s = slice(lo, lo + TILE[0])
        for at in range(0, len(j), TILE[1]):
            t = slice(at, at + TILE[1])
            if i[s][-1] <= j[at]:
                break
            yield s, t, None if i[lo] > j[t][-1] else i[s][:, None] > j[None, t]


def cosine_pairs(vectors: DataFrame, key: str, vector: str, block: int = 1024) -> DataFrame:
    """(i, j, cosine) of all pairs i > j of a matrix, the result the operator is asked for; blocks of keys meet once each, as matrix products."""

    def run(table: pa.Table) -> pa.Table:
        (i, a), (j, b) = _sides(table, ["v"])
        width = max(a.shape[1], b.shape[1])  # a block without a vector has one NaN a row
        a, b = (m if m.shape[1] == width else np.full((len(m), width), np.nan) for m in (a, b))
        x, y = np.nonzero(i[:, None] > j[None, :])
        return pa.table({"i": i[x], "j": j[y], "cosine": (a @ b.T)[x, y]})

    rows = vectors.select(key, _numbers(vectors, vector).alias("v"))
    out = _blocks_of(rows, key, block, ["v"]).groupBy("p", "q").applyInArrow(run, "i long, j long, cosine double")
    return out.select("i", "j", F.when(~F.isnan("cosine"), F.col("cosine")).alias("cosine"))


def cosine_summary(vectors: DataFrame, key: str, vector: str, block: int | None = None) -> DataFrame:
    """(i, n, nearest, mean) of each vector against all with smaller keys: summed up inside the blocks, tile by tile, so no pair leaves its task."""

    def run(table: pa.Table) -> pa.Table:
        sides = _sides(table, ["v"])
        keys, others = sides[0][0], sides[1][0]
        good = np.isfinite(sides[0][1]).all(1)
        (i, a), (j, b) = map(_sound, sides)
        top, total = np.full(len(i), -np.inf), np.zeros(len(i))
        for s, t, below in _tiles(i, j):
            c = a[s] @ b[t].T
            top[s] = np.maximum(top[s], (c if below is None else np.where(below, c, -np.inf)).max(1))
            total[s] += (c if below is None else np.where(below, c, 0)).sum(1)
        n = np.searchsorted(others, keys)
        valid, nearest, sums = np.zeros(len(keys), np.int64), np.full(len(keys), np.nan), np.zeros(len(keys))
        valid[good], nearest[good], sums[good] = np.searchsorted(j, i), np.where(np.isfinite(top), top, np.nan), total
        some = n > 0
        return pa.table({"i": keys[some], "n": n[some], "valid": valid[some], "top": nearest[some], "total": sums[some]})

    rows = vectors.select(key, _numbers(vectors, vector).alias("v"))
    parts = _blocks_of(rows, key, block, ["v"]).groupBy("p", "q").applyInArrow(run, "i long, n long, valid long, top double, total double")
    parts = parts.withColumn("top", F.when(~F.isnan("top"), F.col("top")))
    return parts.groupBy("i").agg(F.sum("n").alias("n"), F.max("top").alias("nearest"), F.when(F.sum("valid") > 0, F.sum("total") / F.sum("valid")).alias("mean"))


def _bins(values: np.ndarray, digits: int) -> np.ndarray:
    """Similarities, which are overwritten, as whole numbers of 10**-digits, from 0 for -1; halves go away from zero, as rounding does in SQL."""
    values *= 10.0**digits
    values += np.copysign(0.5, values)
    found = values.astype(np.int64)
    found += 10**digits
    return found


def matrix_rank_correlation(vectors: DataFrame, key: str, a: str, b: str, digits: int = 6, block: int | None = None) -> DataFrame:
    """(rho, n): Spearman's correlation of the lower triangles of the cosine matrices of two sets of vectors of the same rows.

    Similarities are ranked after rounding to `digits`, so they are whole numbers within 10**digits of zero, and ties share their
    rank. Block products are computed twice, tile by tile, and never stored: first into counts of the values of each matrix, whose running totals are the ranks, then to
    look each pair's ranks up and sum their products. What moves are the blocks of vectors and at most 2 * 10**digits + 1 counts a matrix from each task,
    however many pairs there are. Pairs in which a vector is null, of zero length or not finite in one matrix count in neither."""

    size = 2 * 10**digits + 1

    def both(table: pa.Table):
        (i, x, y), (j, u, v) = (_sound(side) for side in _sides(table, ["x", "y"]))
        for s, t, below in _tiles(i, j):
            one, two = x[s] @ u[t].T, y[s] @ v[t].T
            yield tuple(_bins(c.ravel() if below is None else c[below], digits) for c in (one, two))

    def counts(table: pa.Table) -> pa.Table:
        n = np.zeros((2, size), np.int64)
        for pair in both(table):
            for side in (0, 1):
                n[side] += np.bincount(pair[side], minlength=size)
        side, value = np.nonzero(n)
        return pa.table({"side": pa.array(side, pa.int32()), "value": value, "n": n[side, value]})

    number = lambda c: F.when(F.forall(F.col(c), lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))), _numbers(vectors, c))
    rows = vectors.select(F.col(key).alias("k"), number(a).alias("x"), number(b).alias("y")).filter("k is not null and x is not null and y is not null")
    pairs = _blocks_of(rows, "k", block, ["x", "y"])
    histogram = pairs.groupBy("p", "q").applyInArrow(counts, "side int, value long, n long").groupBy("side", "value").agg(F.sum("n").alias("n"))
    n = np.zeros((2, size), np.int64)  # bounded by the rounding, whatever the number of pairs
    for part in histogram.toArrow().to_batches():
        n[part["side"].to_numpy(), part["value"].to_numpy()] = part["n"].to_numpy()
    total = int(n[0].sum())
    if total < 2:
        return vectors.sparkSession.createDataFrame([(None, total)], "rho double, n long")
    ranks = np.cumsum(n, 1) - (n - 1) / 2.0 - (total + 1) / 2.0
    spread = [math.fsum(n[side] * ranks[side] * ranks[side]) for side in (0, 1)]
    if min(spread) <= 0:
        return vectors.sparkSession.createDataFrame([(None, total)], "rho double, n long")
    shared = vectors.sparkSession.sparkContext.broadcast(ranks)

    def sums(table: pa.Table) -> pa.Table:
        return pa.table({"xy": [math.fsum(float(shared.value[0][one] @ shared.value[1][two]) for one, two in both(table))]})

    out = pairs.groupBy("p", "q").applyInArrow(sums, "xy double").agg(F.sum("xy").alias("xy"))
    return out.select((F.col("xy") / math.sqrt(spread[0]) / math.sqrt(spread[1])).alias("rho"), F.lit(total).cast("long").alias("n"))


def mean_vector(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """(by, pos, mean) of the vectors of each group: one aggregation, no vector is collected."""
    return rows.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
