"""The jobs: whole runs against plain loops and SQL, second runs, growing input, failures between steps, command lines."""

from __future__ import annotations

import collections
import json
import math
import os
import re
import subprocess
import sys

import pytest
from oracle_compare import connection, same

from jobs import collate_scores, common, queries, word_contexts
from jobs.collate_scores import AVERAGE

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered(spark, name):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    assert same(queries.queries()[name](spark, DATA), connection(DATA), queries.ORACLES[name]) == ""
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_nothing_of_llm():
    for name in os.listdir(os.path.join(ROOT, "jobs")):
        if name.endswith(".py"):
            with open(os.path.join(ROOT, "jobs", name)) as f:
                assert not re.search(r"llm|corpus_pipeline", f.read())


# ---- contexts of a growing corpus ----------------------------------------------------------------

TEXTS = [
    ("en", "The cat sat. The cat sat on the mat! Was the dog there?"),
    ("en", "the cat sat on the mat"),
    ("en", None),
    ("en", ""),
    ("en", "   \n "),
    (None, "the cat has no language. The CAT."),
    ("de", "Die Katze sah the cat. Ja."),
    ("en", "one. two. three."),
    ("en", "a b c d e f cat " * 30),
    ("fr", "nothing here"),
    ("en", "the cat sat on the mat"),
]
TARGETS = [("the cat is a mat",), (None,), ("Dog sat",)]


def plain_contexts(texts, targets, longest=3, top=2, least=2):
    words = {w for (t,) in targets if t for w in t.lower().split() if len(w) >= least}
    counts, totals, freq = collections.defaultdict(collections.Counter), collections.Counter(), collections.Counter()
    for lang, text in texts:
        for s in re.split(r"(?<=[.!?])\s+", text or ""):
            t = s.lower().split()
            for i in range(1, len(t)):
                totals[lang] += 1
                if t[i] in words:
                    counts[lang, t[i]][" ".join(t[max(0, i - longest) : i])] += 1
                    freq[lang, t[i]] += 1
    out = {("word", lang, w, None, n, None) for (lang, w), n in freq.items()}
    for (lang, w), c in counts.items():
        out |= {("context", lang, w, ctx, n, k + 1) for k, (ctx, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:top])}
    return out, {k: math.log10(n / totals[k[0]] * 1e6) for k, n in freq.items()}


class Corpus:
    """A folder of Parquet files that grows, beside a table of targets."""

    def __init__(self, spark, root):
        self.spark, self.docs, self.out = spark, str(root / "docs"), str(root / "out")
        self.targets = self.put_targets(str(root / "targets"), TARGETS)
        self.settings = {"longest": 3, "top": 2, "files_per_batch": 2}

    def put_targets(self, path, rows):
        self.spark.createDataFrame(rows, "text string").write.parquet(path)
        return path

    def add(self, rows):
        self.spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, extra int").coalesce(1).write.mode("append").parquet(self.docs)

    def run(self, targets=None, **more):
        return word_contexts.run(self.spark, self.docs, targets or self.targets, self.out, self.settings | more)

    def found(self):
        rows = word_contexts.output(self.spark, self.out).collect()
        return {(r.kind, r.language, r.word, r.ctx, r.n, r.place) for r in rows}, {(r.language, r.word): r.log_per_million for r in rows if r.kind == "word"}

    def check(self, texts, targets=TARGETS, **how):
        (got, got_logs), (want, want_logs) = self.found(), plain_contexts(texts, targets, **how)
        assert got == want
        assert got_logs.keys() == want_logs.keys() and all(abs(got_logs[k] - v) < 1e-9 for k, v in want_logs.items())


@pytest.fixture
def corpus(spark, tmp_path):
    return Corpus(spark, tmp_path)


def test_growing_corpus(corpus):
    """Two runs over growing input take each row once; a third has nothing to take and changes nothing."""
    corpus.add(TEXTS[:4])
    assert corpus.run()["rows"] == 4
    corpus.check(TEXTS[:4])
    for part in (TEXTS[4:6], TEXTS[6:7], TEXTS[7:]):
        corpus.add(part)
    second = corpus.run()
    assert second["rows"] == len(TEXTS) - 4 and second["batches"] == 2  # three files, two a batch
    corpus.check(TEXTS)
    third = corpus.run()
    assert (third["rows"], third["batches"]) == (0, 0)
    corpus.check(TEXTS)


def test_other_ways_give_the_same(corpus):
    corpus.add(TEXTS)
    corpus.run(broadcast_targets=0)  # targets meet words by a shuffle
    corpus.check(TEXTS)
    corpus.run(top=5)  # a number of contexts may change freely
    corpus.check(TEXTS, top=5)


def test_failures_are_mended(corpus, monkeypatch):
    """A batch that fails after it wrote is written again, not added; a run that fails before it publishes is published by the next."""
    corpus.add(TEXTS[:5])
    honest = word_contexts.run_available

    def dies_after_writing(source, count, out, checkpoint):
        def batch(rows, number):
            count(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")
            raise RuntimeError("lost")

        source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    monkeypatch.setattr(word_contexts, "run_available", dies_after_writing)
    with pytest.raises(Exception, match="lost"):
        corpus.run()
    monkeypatch.setattr(word_contexts, "run_available", honest)
    assert corpus.run()["rows"] == 5
    corpus.check(TEXTS[:5])

    corpus.add(TEXTS[5:])
    real = word_contexts.published
    monkeypatch.setattr(word_contexts, "published", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        corpus.run()
    monkeypatch.setattr(word_contexts, "published", real)
    assert corpus.run()["rows"] == 0
    corpus.check(TEXTS)


def test_other_targets_count_anew(corpus, tmp_path):
    corpus.add(TEXTS)
    corpus.run()
    other = [("language katze",)]
    assert corpus.run(corpus.put_targets(str(tmp_path / "other"), other))["rows"] == len(TEXTS)
    corpus.check(TEXTS, other)
    assert corpus.run()["rows"] == 0  # the first set is still counted
    corpus.check(TEXTS)


def test_no_targets_and_no_rows(corpus, tmp_path):
    corpus.add([])
    assert corpus.run()["rows"] == 0 and corpus.found()[0] == set()
    corpus.add(TEXTS)
    corpus.run(corpus.put_targets(str(tmp_path / "none"), [(None,), ("",)]))
    assert corpus.found()[0] == set()


def test_settings_are_checked(corpus):
    corpus.add(TEXTS)
    with pytest.raises(ValueError, match="unknown settings: tops"):
        corpus.run(tops=3)
    with pytest.raises(ValueError, match="missing settings: gold, predictions"):
        collate_scores.run(corpus.spark, corpus.docs, corpus.docs, corpus.out, {})


def files(path):
    return sorted(os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet"))


def test_no_news_leaves_the_tables(corpus):
    """A run that finds nothing newer writes no table; a new setting, a new file or a lost table is published."""
    corpus.add(TEXTS[:4])
    first, was = corpus.run(), None
    tables = lambda: files(f"{corpus.out}/contexts") + files(f"{corpus.out}/words")
    was = tables()
    again = corpus.run()
    assert tables() == was and again == first | {"batches": 0, "rows": 0}
    corpus.run(top=5)
    assert tables() != was
    corpus.check(TEXTS[:4], top=5)
    for f in files(f"{corpus.out}/contexts"):
        os.remove(f)
    corpus.run(top=5)
    corpus.check(TEXTS[:4], top=5)
    corpus.add(TEXTS[4:])
    corpus.run()
    corpus.check(TEXTS)


def test_half_published_is_mended(corpus, monkeypatch):
    """Where one table was written with another setting and the other wasn't, the mark of before doesn't count."""
    corpus.add(TEXTS)
    corpus.run()
    real = word_contexts.published
    monkeypatch.setattr(word_contexts, "published", lambda *a: (real(*a)[0], None))
    with pytest.raises(AttributeError):
        corpus.run(top=1)
    monkeypatch.setattr(word_contexts, "published", real)
    corpus.run()
    corpus.check(TEXTS)


@pytest.mark.parametrize(("longest", "least"), [(1, 1), (3, 0), (3, 2), (3, 3), (3, 4), (17, 2), (None, 2)])
def test_counts_are_those_of_whole_contexts(spark, longest, least):
    rows, words = spark.createDataFrame(TEXTS, "lang string, text string"), spark.createDataFrame([("the",), ("cat",), ("sat",)], "word string")
    want = collections.Counter()
    for lang, text in TEXTS:
        for s in re.split(r"(?<=[.!?])\s+", text or ""):
            t = s.lower().split()
            for i in range(1, len(t)):
                before = t[max(0, i - longest) if longest else 0 : i]
                known = t[i] in ("the", "cat", "sat")
                want[lang, t[i] if known else None, " ".join(before) if known and len(before) >= least else None] += 1
    for few in (True, False):
        got = word_contexts.counted(rows, words, word_contexts.DEFAULTS | {"longest": longest, "least_tokens": least}, few)
        assert sorted(map(repr, (((r.language, r.word, r.ctx), r.n) for r in got.collect()))) == sorted(map(repr, want.items()))
    if longest == 3:
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "transform(" not in plan and "array_join(" not in plan  # no function of each of a row's words


def test_one_batch_is_published_without_a_shuffle_of_contexts(spark):
    """The counts of one batch are sums; what is cut before the sort changes nothing, ties and words of few contexts neither."""
    rows = [(lang, f"w{w}", f"c{c:02}", 1 + (c * c * (w + 1)) % (1 + 3 * w)) for lang in ("a", None) for w in range(5) for c in range(3 + 4 * w)]
    counts = spark.createDataFrame([*rows, ("a", None, None, 50), (None, None, None, 9), ("a", "w0", None, 4)], word_contexts.COUNTS)
    want = [sorted(map(repr, t.collect())) for t in word_contexts.published(counts, 4)]
    for few in (True, False):
        got = word_contexts.published(counts, 4, True, few)
        assert [sorted(map(repr, t.select(*u.columns).collect())) for t, u in zip(got, word_contexts.published(counts, 4))] == want
        shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", got[0]._jdf.queryExecution().executedPlan().toString())
        assert shuffles and not any("ctx" in keys for keys in shuffles)
    kept = word_contexts.frequent(counts.filter("ctx is not null"), 4).count()
    assert 4 * 4 <= kept < len(rows)


def test_one_file_is_many_tasks(corpus):
    """Many rows of one file are dealt out, with the same counts; few stay where they are."""
    texts = TEXTS * 200
    corpus.add(texts)
    rows = corpus.spark.read.parquet(corpus.docs)
    assert rows.rdd.getNumPartitions() == 1 and word_contexts.dealt(rows, 100).rdd.getNumPartitions() == 1
    assert word_contexts.dealt(rows, len(texts)).rdd.getNumPartitions() == max(4 * corpus.spark.sparkContext.defaultParallelism, int(corpus.spark.conf.get("spark.sql.shuffle.partitions")))
    assert word_contexts.dealt(rows, 100 * word_contexts.FULL).rdd.getNumPartitions() == 100  # tasks grow in number, not in size
    seen, real = [], word_contexts.dealt
    with pytest.MonkeyPatch.context() as m:
        m.setattr(word_contexts, "dealt", lambda rows, n: seen.append(n) or real(rows, n))
        corpus.run()
    assert seen == [len(texts)]
    corpus.check(texts)


# ---- the leaderboard ---------------------------------------------------------------------------------

SAID = {"predictions": {"model": "m", "item": "i", "answer": "a", "order": ["at"]}, "gold": {"item": "i", "answer": "a", "task": "t", "subtask": "s"}}
GOLD = [(f"{t}{k}", f"right {k}", t, s) for t, s, n in (("x", "one", 3), ("x", "two", 2), ("y", "one", 4), ("z", None, 2)) for k in range(n) for t, s in [(t, s)]]
GOLD = [(f"{i}-{s}", a, t, s) for i, a, t, s in GOLD] + [("no task", "a", None, "one"), (None, "a", "x", "one"), ("x0-one", "right 0", "x", "one")]


def answers():
    rows = []
    for k, (item, a, _, _) in enumerate(GOLD):
        rows += [("good", item, f" {a}\t", 1), ("fair", item, a if k % 2 else "wrong", 1)]
        if k % 3 == 0:
            rows.append(("rare", item, a, 1))
    rows += [("fair", "x1-one", "wrong", 2), ("good", "x0-one", "wrong", 0), ("good", "elsewhere", "a", 1), (None, "x0-one", "a", 1), ("null", "y1-one", None, 1)]
    return rows


def plain_scores(predictions, gold, tasks=None):
    golden = {}
    for i, a, t, s in gold:
        if i is not None and t is not None:
            golden[i] = min(golden.get(i, (t, s, a)), (t, s, a))
    last = {}
    for m, i, a, at in predictions:
        if m is not None and i is not None and (at, a or "") >= last.get((m, i), (-1, "", None))[:2]:
            last[m, i] = (at, a or "", a)
    sizes = collections.Counter((t, s or "") for t, s, _ in golden.values())
    cells = {}
    for (m, i), (_, _, a) in last.items():
        if i in golden:
            t, s, g = golden[i]
            cell = cells.setdefault((t, s or "", m), [sizes[t, s or ""], 0, 0])
            cell[1] += 1
            cell[2] += a is not None and a.strip() == g.strip()
    rows = {k: (*v, v[2] / v[0]) for k, v in cells.items()}
    tasks = sorted({t for t, _ in sizes})
    parts = {t: [s for u, s in sizes if u == t] for t in tasks}
    total = {t: sum(sizes[t, s] for s in parts[t]) for t in tasks}
    for t in tasks:
        for m in {k[2] for k in cells if k[0] == t}:
            own = [rows[t, s, m] for s in parts[t] if (t, s, m) in cells]
            rows[t, None, m] = (total[t], sum(v[1] for v in own), sum(v[2] for v in own), sum(v[3] for v in own) / len(parts[t]))
    for m in {k[2] for k in cells}:
        own = [v for k, v in rows.items() if k[1] is None and k[2] == m]
        rows[AVERAGE, None, m] = (sum(total.values()), sum(v[1] for v in own), sum(v[2] for v in own), sum(v[3] for v in own) / len(tasks))
    place = lambda k: 1 + sum(v[3] > rows[k][3] + 1e-12 for j, v in rows.items() if j[:2] == k[:2])
    found = {(*k, *v[:3], round(v[3], 9), v[1] == v[0], place(k)) for k, v in rows.items()}
    gold = {(t, s): n for (t, s), n in sizes.items()} | {(t, None): n for t, n in total.items()} | ({(AVERAGE, None): sum(total.values())} if tasks else {})
    return found | {(t, s, None, n, 0, 0, None, False, None) for (t, s), n in gold.items()}


class Board:
    def __init__(self, spark, root):
        self.spark, self.root, self.out = spark, root, str(root / "out")

    def put(self, name, rows, schema):
        path = str(self.root / name)
        self.spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
        return path

    def run(self, predictions, gold=GOLD, tasks=None):
        p = self.put("predictions", predictions, "m string, i string, a string, at int")
        return collate_scores.run(self.spark, p, self.put("gold", gold, "i string, a string, t string, s string"), self.out, SAID | {"tasks": tasks})

    def found(self):
        rows = collate_scores.output(self.spark, self.out).collect()
        assert all(abs(r.coverage - r.answered / r.total) < 1e-12 for r in rows)
        got = [(r.task, r.subtask, r.model, r.total, r.answered, r.correct, None if r.score is None else round(r.score, 9), r.complete, r.place) for r in rows]
        assert len(set(got)) == len(got)
        return set(got)


@pytest.fixture
def board(spark, tmp_path):
    return Board(spark, tmp_path)


def test_leaderboard(board):
    done = board.run(answers())
    assert done["tasks"] == ["x", "y", "z"] and (done["predictions"], done["gold"]) == (len(answers()), len(GOLD)) and board.found() == plain_scores(answers(), GOLD)
    board.run(answers())
    assert board.found() == plain_scores(answers(), GOLD)


def test_one_task_anew(board):
    """With a list of tasks the others' partitions stay, and averages follow; the same as a whole run."""
    board.run(answers())
    better = [*answers(), *[("rare", i, a, 5) for i, a, t, _ in GOLD if t == "y"]]
    board.run(better, tasks=["y"])
    assert board.found() == plain_scores(better, GOLD)
    less = [g for g in GOLD if g[2] != "z"]
    board.run(better, less)  # a whole run drops what is gone
    assert board.found() == plain_scores(better, less)


def test_nothing_to_collate(board):
    board.run([])
    assert board.found() == plain_scores([], GOLD)
    board.run(answers(), [])
    assert board.found() <= {(AVERAGE, None, None, 0, 0, 0, None, True, None)} or not board.found()


# ---- command lines -------------------------------------------------------------------------------------


def call(name, *args):
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_LOCAL_IP": "127.0.0.1"}
    out = subprocess.run([sys.executable, "-m", f"jobs.{name}", *args], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-3000:]
    return out.stderr


def test_command_lines(spark, tmp_path):
    corpus = Corpus(spark, tmp_path)
    corpus.add(TEXTS)
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"longest": 3, "top": 2}))
    said = call("word_contexts", "--corpus", corpus.docs, "--targets", corpus.targets, "--out", corpus.out, "--config", str(config))
    assert f"read {len(TEXTS)} new rows" in said and "wrote" in said
    corpus.check(TEXTS)

    board = Board(spark, tmp_path / "board")
    p, g = board.put("p", answers(), "m string, i string, a string, at int"), board.put("g", GOLD, "i string, a string, t string, s string")
    config.write_text(json.dumps(SAID))
    said = call("collate_scores", "--predictions", p, "--gold", g, "--out", board.out, "--config", str(config))
    assert "task=average has" in said and f"read {len(GOLD)} rows" in said and board.found() == plain_scores(answers(), GOLD)


def test_shipped_configs():
    for job in (collate_scores, word_contexts):
        name = job.__name__.split(".")[-1]
        assert common.checked(queries.settings(name), job.DEFAULTS)
