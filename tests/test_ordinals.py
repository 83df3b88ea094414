"""Ordinals and running totals against a plain loop, with few and many ranges, ties of the first column, nulls and empty tables."""

import collections
import random

import pytest

from tallyspark.operators import ordinals


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    made = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(40)]), k, r.randrange(-50, 50)) for k in range(600)]
    return made + [("hot", 7, 1000 + k, 1) for k in range(300)]


@pytest.mark.parametrize("parts", [1, 2, 64])
def test_running(spark, rows, parts):
    df = spark.createDataFrame(rows, "g string, first long, id long, n long").repartition(5)
    got = {r.id: (r.total, r.mixed, r.seq) for r in ordinals.numbered(ordinals.running(df, ["g"], ["first", "id"], {"total": ("n", "sum"), "mixed": ("n", "bit_xor")}, parts), ["g"], ["first", "id"], parts=parts).collect()}
    state, want = collections.defaultdict(lambda: [0, 0, 0]), {}
    for g, first, i, n in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        s = state[g]
        s[0], s[1] = s[0] + n, s[1] ^ n
        want[i] = (*s[:2], s[2])
        s[2] += 1
    assert got == want


def test_running_empty(spark):
    df = spark.createDataFrame([], "g string, first long, n long")
    assert ordinals.numbered(df, ["g"], ["first"]).count() == 0


def test_no_window_over_the_group_alone(spark, rows):
    df = spark.createDataFrame(rows, "g string, first long, id long, n long")
    plan = ordinals.numbered(df, ["g"], ["first", "id"])._jdf.queryExecution().optimizedPlan().toString()
    assert all("__range" in line for line in plan.splitlines() if line.strip().lstrip(":+- ").startswith("Window"))


@pytest.mark.parametrize("parts", [1, 64])
def test_next(spark, rows, parts):
    df = spark.createDataFrame(rows, "g string, first long, id long, n long").repartition(3)
    got = {r.id: (r.after, r.m) for r in ordinals.with_next(df, ["g"], ["first", "id"], {"after": "id", "m": "n"}, parts).collect()}
    groups = collections.defaultdict(list)
    for g, first, i, n in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        groups[g].append((i, n))
    assert got == {a[0]: b for v in groups.values() for a, b in zip(v, v[1:])}


def test_splits_and_tokens(spark):
    from pyspark.sql import functions as F

    from tallyspark.operators import relate, text

    df = spark.createDataFrame([(k, ["a", "b", None][k % 3]) for k in range(100)], "id long, g string")
    got = relate.split_by_hash(df, F.col("id"), ["g"], 0.3).collect()
    import hashlib

    for g in ("a", "b", None):
        mine = sorted((r.id for r in got if r.g == g), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert {r.id for r in got if r.g == g and r.split == "valid"} == set(mine[: -(-len(mine) * 3 // 10)])
    said = ["one two  three", "", "é 😀x"]
    rows = text.token_table(spark.createDataFrame(list(enumerate(said)), "id int, t string"), ["id"], F.col("t")).collect()
    assert sum(len(x.split(" ")) for x in said) == len(rows) and all(said[r.id][r.char_start : r.char_end] == r.token for r in rows)


@pytest.mark.parametrize("longest", [1, 3, 50, None])
def test_contexts(spark, longest):
    from pyspark.sql import functions as F

    from tallyspark.operators import text

    said = ["The cat sat on the mat", "one", "", None, "a  b\nc", " ".join(f"W{k}" for k in range(40))]
    got = collections.Counter((r.id, r.ctx, r.word) for r in text.contexts(spark.createDataFrame(list(enumerate(said)), "id int, t string"), F.col("t"), longest, carry=["id"]).collect())
    want = collections.Counter()
    for k, s in enumerate(said):
        w = (s or "").lower().split()
        want.update((k, " ".join(w[max(0, i - longest) if longest else 0 : i]), w[i]) for i in range(1, len(w)))
    assert got == want


def test_options_take_one_shuffle(spark):
    """Lines of an order stay together from the first shuffle on: no ranges, cuts or joins for groups of a few rows."""
    from tallyspark.plans import catalogue

    plan = catalogue._options(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_ranges_are_compiled(spark):
    """A row's range is a sum of comparisons; what gold queries number twice comes from a table, not from its making again."""
    import math

    from pyspark.sql import functions as F
    from tallyspark.plans import evaluation

    df = spark.createDataFrame([(x,) for x in (None, -1.0, 1.0, 1.5, 2.0, 9.0, math.nan)], "x double")
    got = [r.r for r in df.select(ordinals.range_of(F.col("x"), [1.0, 2.0, 3.0]).alias("r")).collect()]
    assert got == [None, 0, 0, 1, 1, 3, 3]
    assert [r.r for r in df.select(ordinals.range_of(F.col("x"), []).alias("r")).collect()] == [None] + [0] * 6
    rows = spark.range(1000).selectExpr("id % 3 as g", "id as first")
    assert "lambda" not in ordinals.numbered(rows, ["g"], ["first"], parts=8)._jdf.queryExecution().optimizedPlan().toString()
    pred, l, _ = evaluation._predictions(spark, "/root/testdata/sf0.001")
    assert all("Exchange" not in x._jdf.queryExecution().executedPlan().toString() for x in (pred, l))
