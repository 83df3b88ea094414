"""JSON documents written as sorted lines."""

from __future__ import annotations

import json
import os
import random

import pytest

from tallyspark.sources import readers, writers

SCHEMA = "uid string, seq long, pred string"
ODD = ['quote " and \\', "line\nend\r", "tab\t", "é😀 ", "", None, "\U0010ffff", "{}[],:"]


def predictions(seed, uids, n):
    r = random.Random(seed)
    return [(u, k, r.choice(ODD + ["answer"])) for u in uids for k in range(r.randrange(1, n))]


def plain(rows):
    out = {}
    for u, k, p in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1])):
        out.setdefault(u, {"predictions": []})["predictions"].append({"id": f"{u}_{k}"} | ({"pred": p} if p is not None else {}))
    return out


def written(lines, path):
    writers.write_text(lines, path)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) == 1
    with open(os.path.join(path, files[0]), encoding="utf-8") as f:
        return f.read()


def test_prediction_document(spark, tmp_path):
    rows = predictions(1, ["u", "v w", 'odd "one"', "é", "", "\U0010fffe"], 60) + [(None, 0, "nobody's")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert json.loads(written(writers.prediction_document(df), str(tmp_path / "d"))) == plain(rows)
    back = readers.predictions(spark, str(tmp_path / "d")).collect()
    assert sorted((r.uid, r.seq, r.pred or "") for r in back) == sorted((u, k, p or "") for u, k, p in rows if u is not None)
    assert json.loads("".join(r.value for r in writers.prediction_document(df.filter("false")).collect())) == {}


def test_collated_document(spark, tmp_path):
    parts = {t: predictions(k, [f"{t}{j}" for j in range(k)], 20) for k, t in enumerate(("zero", "a", 'b"', "c"))}
    frames = {t: spark.createDataFrame(x, SCHEMA).repartition(3) for t, x in parts.items()} | {"missing": None}
    fast = spark.createDataFrame([(2, {"u": 0.5, "v": None}), (0, None), (7, {"u": 1.0})], "ord int, scores map<string,double>")
    want = {t: plain(x) for t, x in parts.items()} | {"missing": None}
    assert json.loads(written(writers.collated(frames), str(tmp_path / "a"))) == want
    got = json.loads(written(writers.collated(frames, fast), str(tmp_path / "b")))
    assert got == want | {"fast_eval_results": [None, {"u": 0.5, "v": None} if "v" in got["fast_eval_results"][1] else {"u": 0.5}, {"u": 1.0}]}
    assert json.loads(written(writers.collated({}, fast.filter("false")), str(tmp_path / "c"))) == {"fast_eval_results": []}


@pytest.mark.parametrize("n", [3000])
def test_nothing_is_gathered(spark, n):
    df = spark.range(n).selectExpr("concat('u', id % 3) as uid", "id div 3 as seq", "repeat('x', 20) as pred")
    lines = writers.prediction_document(df)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and lines.count() == n + 3 * 2 + 2
