"""The pipeline as a whole on a small table, each decision by a plain version of it."""

from __future__ import annotations

import random


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(4)
    word = lambda: r.choice(["ba", "du", "kel", "mor"]) + r.choice(["na", "rix", "lo"]) + str(r.randrange(90))
    lines = lambda n: "\n".join(" ".join(word() for _ in range(9)) for _ in range(n))
    item = " ".join(word() for _ in range(20))
    clean = {k: lines(8) for k in range(10)}
    shared = " ".join(word() for _ in range(60))
    rows = dict(clean) | {20: clean[3], 21: lines(3) + "\n" + shared, 22: lines(3) + "\n" + shared, 23: lines(4) + " you idiot and moron, you worthless scum. trash loser", 24: lines(3) + "\n" + item, 25: None, 26: ""}
    near = clean[5].replace("\n", " ")
    rows[27] = near
    w = near.split()
    w[10] = "changed"
    rows[28] = " ".join(w)
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in p.run(spark, str(tmp_path)).collect()}
    # 20 copies 3 whole, 23 is toxic, 24 holds an item, 27 and 28 are near copies of 5
    assert set(got) == set(rows) - {20, 23, 24, 27, 28}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = p.lines(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    text = {x.doc_id: x.text for x in out.collect()}
    assert shared in text[21] and shared not in text[22] and text[0] == clean[0]
    import hashlib

    assert got[0].decoded_sha256 == hashlib.sha256(clean[0].encode()).hexdigest()


def test_pipeline_odd_rows(spark, tmp_path):
    """Null ids and texts, empty, blank and very long texts, repeated rows, extra columns with clashing names, in every stage and in the whole."""
    import corpus_pipeline as p

    r = random.Random(5)
    word = lambda: r.choice(["ba", "du", "kel", "mor"]) + r.choice(["na", "rix", "lo"]) + str(r.randrange(9000))
    prose = lambda n: " ".join(word() for _ in range(n))
    long = "\n".join(prose(12) for _ in range(20_000))
    rows = [(1, prose(40)), (1, None), (2, long), (None, "null id " + prose(30)), (None, None), (4, ""), (5, " \n\t"), (6, None), (7, "one word"), (9, long.split("\n")[0])]
    rows += [rows[0], rows[2], rows[3], rows[5], rows[7]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_deleted string, blocks int, component_id long, score double, __id int"
    docs = spark.createDataFrame([(i, x, None, "s", None if x is None else len(x), f"d{k}", k, 5, None, 3) for k, (i, x) in enumerate(rows)], schema)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(20)), (None, "x y"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        # only the single line of 9 is a copy, of the first in 2: it is rare, and all that 9 has
        want = [tuple(x) for x in docs.collect() if name != "lines" or x.doc_id != 9]
        assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in out.collect()), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id or -1) for x in got) == sorted((i or -1) for i, _ in rows if i != 9)
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert p.run(spark, f"{tmp_path}/empty").count() == 0
