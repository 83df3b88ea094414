"""Sources, sinks, decoders, statistics, the task layer and streaming on synthesized files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions.scalars import step_number, strip, tokens
from tallyspark.operators import decode, rank, relate, report, stats, tasks, text
from tallyspark.sources import readers, writers


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")
    return str(path)


def jsonl(rows):
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


def test_jsonl_and_minimal_pairs(spark, tmp_path):
    write(tmp_path / "t/agreement.jsonl", jsonl([{"sentence_good": "a b", "sentence_bad": "b a", "field": "syntax_semantics", "UID": "u1", "linguistics_term": "x"}]))
    write(tmp_path / "t/extra.jsonl", jsonl([{"sentence_good": "c", "sentence_bad": "d"}]))
    write(tmp_path / "t/notes.txt", "no task")
    rows = readers.jsonl(spark, str(tmp_path / "t"), "minimal_pairs")
    got = {r.uid: r for r in decode.decode("minimal_pairs", rows, stem=rows.stem).collect()}
    assert set(got) == {"u1", "extra"}
    assert got["u1"].meta == {"field": "syntax/semantics", "linguistics_term": "x"} and got["extra"].meta["field"] == "supplement"
    assert [c.sentence for c in got["u1"].candidates] == ["a b", "b a"]
    with pytest.raises(NotImplementedError):
        decode.decode("nothing", rows)


def test_ordered_lines(spark, tmp_path):
    write(tmp_path / "o/a.jsonl", jsonl([{"numops": k} for k in (5, 3, 9)]))
    got = readers.jsonl_ordered(spark, str(tmp_path / "o"), "numops int").collect()
    assert sorted((r.line_no, r.numops) for r in got) == [(0, 5), (1, 3), (2, 9)]


def test_decoders(spark):
    w = spark.createDataFrame([("d", "c1", "c2", "t1", "t2", "x", "y", "z")], readers.SCHEMAS["world_knowledge"])
    got = decode.decode("world_knowledge", w).collect()
    assert [[c.sentence for c in r.candidates] for r in got] == [["c1 t1", "c2 t1"], ["c2 t2", "c1 t2"]] and got[0].candidates[0].completion == " t1"
    e = spark.createDataFrame([("in ", ["a", "b", "c"], 2)], readers.SCHEMAS["entity_tracking"])
    got = decode.decode("entity_tracking", e).first()
    assert got.uid == "regular_2_ops" and [c.sentence for c in got.candidates] == ["in a", "in b", "in c"]
    v = spark.createDataFrame([("q", "t", None, 1), ("q", "t", ["a", "b", "c"], 2)], readers.SCHEMAS["distractors"])
    assert [len(r.candidates) for r in decode.decode("distractors", v).collect()] == [1, 4]
    p = spark.createDataFrame([("good", "bad", "flies")], readers.SCHEMAS["concept_pairs"])
    from pyspark.sql import functions as F

    names = [decode.decode("concept_pairs", p, stem=F.lit(s)).first().uid for s in ("x_base", "x_wugs", "x_dist-before", "x_dist-in-between")]
    assert names == ["base", "wugs", "wugs_dist_before", "wugs_dist_in_between"]
    c = spark.createDataFrame([("a", "b", "t", "x", "y", 1, "k")], readers.SCHEMAS["captions"])
    assert decode.decode("captions", c).first().meta["sub_feature"] == "x y"
    rest = c.select(decode.other_columns(c, ["caption_0", "caption_1"]).alias("m")).first().m
    assert "caption_0" not in rest and len(rest) == len(c.columns) - 2


def test_rank_rules(spark):
    nan = float("nan")
    rows = [(1, 0, 0.5), (1, 1, 0.5), (2, 0, nan), (2, 1, -3.0), (3, 0, nan), (3, 1, nan), (4, 0, 1.0), (5, 0, None), (5, 1, -1e9)]
    s = spark.createDataFrame(rows, "item long, cand_idx int, logprob double")
    got = {r.item: r.chosen for r in rank.choose(s, ["item"]).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}
    assert {r.item: r.ties for r in rank.tie_sizes(s, ["item"]).collect()} == {1: 2, 2: 1, 3: 2, 4: 1, 5: 1}
    assert set(r.chosen for r in rank.choose(s.filter("item = 1"), ["item"], tie="hash").collect()) <= {0, 1}
    best = spark.createDataFrame([(1.0, 50.0), (0.5, 50.0), (2.0, 40.0)], "temp double, acc double")
    assert rank.best_setting(best, "temp", "acc").first().temp == 0.5


def test_predictions_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("u", 1, "b"), ("u", 0, " a "), ("v", 0, "c")], "uid string, seq long, pred string")
    writers.write_text(writers.prediction_document(p), str(tmp_path / "p"))
    got = readers.predictions(spark, str(tmp_path / "p")).collect()
    assert sorted((r.uid, r.seq, r.id, r.pred) for r in got) == [("u", 0, "u_0", " a "), ("u", 1, "u_1", "b"), ("v", 0, "v_0", "c")]
    gold = spark.createDataFrame([("u", 0, "a"), ("u", 1, "x"), ("u", 2, "z"), ("v", 0, "c")], "uid string, n long, gold string")
    joined = relate.positional(readers.predictions(spark, str(tmp_path / "p")).drop("seq"), gold, ["uid"], ["id"], ["n"])
    assert joined.count() == 3
    assert joined.filter(strip(joined.pred) == joined.gold).count() == 2


def test_submission(spark):
    s = spark.createDataFrame([("a", "y", 0.5), ("a", "x", 1.0), ("b", "z", None)], "task string, subtask string, score double")
    got = json.loads(writers.submission(s).first().value)
    assert got["a"] == {"x": 1.0, "y": 0.5} and got["b"].get("z") is None


def test_tables(spark, tmp_path):
    r = readers.reading(spark, write(tmp_path / "r.csv", "item,word,x\n,a,1.5\n2,b,NaN\n"), ["item", "word", "x"]).collect()
    assert [(a.item, a.x) for a in r] == [("None", 1.5), ("2", None)]
    n = readers.norms(spark, write(tmp_path / "n.csv", "word,16,18,30\nball,0.1,,0.9\n")).collect()
    assert sorted((a.month, a.prop) for a in n) == [(16, 0.1), (18, None), (30, 0.9)]
    m = readers.manifest(spark, write(tmp_path / "m.csv", "image1,image2,text1\na,b,t\n")).first()
    assert (m.images, m.texts) == (["a", "b"], ["t"])
    assert [a.word for a in readers.target_words(spark, write(tmp_path / "w.txt", "dog\n\ncat\n")).collect()] == ["dog", "cat"]
    assert readers.target_words(spark, write(tmp_path / "w.csv", "word\ndog\n")).count() == 1
    with pytest.raises(ValueError):
        readers.target_words(spark, "w.json")
    t = readers.tab_predictions(spark, write(tmp_path / "p.tsv", "index\tprediction\n0\ta\n\n1\n2\tb\tc\n")).collect()
    assert [(a.seq, a.prediction) for a in t] == [(0, "a"), (1, ""), (2, "b\tc")]
    c = readers.word_contexts(spark, write(tmp_path / "c.json", json.dumps({"a": [{"context": "x"}], "dog": [{"context": "x"}, {"context": "y"}], "cat": [{"context": "z"}]})), 2).collect()
    assert sorted((a.word, a.context) for a in c) == [("dog", "x"), ("dog", "y")]
    s = readers.surprisals(spark, write(tmp_path / "s.json", '{"metadata": {"model_name": "m"}, "results": [{"step": "chck_1M", "word_count": 1000000, "target_word": "dog", "context_id": 0, "context": "a", "surprisal": NaN}]}')).first()
    assert s.model == "m" and s.surprisal is None


def test_result_documents(spark, tmp_path):
    write(tmp_path / "res/m/en/arc/all_results.json", json.dumps({"epoch": 1.0, "eval_accuracy": 0.25}))
    r = readers.finetune_results(spark, str(tmp_path / "res")).first()
    assert (r.model, r.language, r.task, r.eval_accuracy) == ("m", "en", "arc", 0.25)
    write(tmp_path / "h/results_1.json", '{"results": {"z": {"alias": "z", "acc,none": 0.5}, "a": {"alias": " a", "acc,none": 0.25}, "b": {"alias": " b"}}}')
    rows = readers.harness_results(spark, str(tmp_path / "h"))
    assert [(a.pos, a.name) for a in rows.orderBy("pos").collect()] == [(0, "z"), (1, "a"), (2, "b")]
    tree = report.alias_tree(rows, ["file"], "pos", "alias", "acc").orderBy("pos").collect()
    assert [(a.depth, a.task, a.acc) for a in tree] == [(0, "z", 0.5), (1, "z", 0.25), (1, "z", None)]
    write(tmp_path / "t/best.txt", "### UID ACCURACY\na: 1\n### AVERAGE ACCURACY\n74.53\n")
    got = readers.text_reports(spark, str(tmp_path / "t"))
    assert got.select(report.average_score(got.text)).first()[0] == 74.53


def test_matrices(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(2, 3))
    got = readers.matrices(spark, str(tmp_path)).collect()
    assert sorted((r.i, r.j, r.value) for r in got) == [(i, j, 3.0 * i + j) for i in range(2) for j in range(3)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "domain string, v int")
    writers.write_splits(rows, str(tmp_path / "s"), ["domain"])
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    writers.write_scores(rows, str(tmp_path / "c"), "\t")
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "c")).count() == 2
    from pyspark.sql import functions as F

    for _ in range(2):  # a repeated revision replaces itself
        writers.append_revision(rows, str(tmp_path / "r"), F.lit("chck_1M"))
    writers.append_revision(rows, str(tmp_path / "r"), F.lit("chck_2M"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4


def test_report_lines(spark):
    acc = spark.createDataFrame([("uid", "a", 50.0), ("uid", "b", 100.0)], "dimension string, value string, accuracy double")
    lines = "\n".join(r.value for r in report.score_report(acc, 1.0).collect())
    assert lines.startswith("TEMPERATURE: 1.00\n### UID ACCURACY\na: 50.00\nb: 100.00") and lines.endswith("### AVERAGE ACCURACY\n75.00")
    wide = report.pivoted(spark.createDataFrame([("m1", "t1", 1.0), ("m1", "t2", 2.0), ("m2", "t1", 3.0)], "m string, t string, v double"), "m", "t", "v", ["t1", "t2"])
    assert {(r.m, r.t1, r.t2, r.average) for r in wide.collect()} == {("m1", 1.0, 2.0, 1.5), ("m2", 3.0, None, 3.0)}
    assert report.markdown(wide, ["m", "t1"]).count() == 4


def test_scalars(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("  a b\t", "chck_2.5K"), ("", None)], "x string, s string")
    got = df.select(strip(df.x), tokens(df.x), step_number(df.s)).collect()
    assert got[0][0] == "a b" and got[1][1] == [] and got[0][2] == 2500 and got[1][2] is None
    assert spark.range(1).select(rank.choose_in_array(F.array(F.lit(float("nan")), F.lit(-1.0)))).first()[0] == 1


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 1 + 2 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    fit = stats.ols(df, "y", ["a", "b"])
    design = np.column_stack([np.ones(200), x])
    want, rss = np.linalg.lstsq(design, y, rcond=None)[:2]
    assert np.allclose(fit["coef"], want) and abs(fit["r2"] - (1 - rss[0] / ((y - y.mean()) ** 2).sum())) < 1e-9
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 197)
    assert np.allclose(fit["t"], want / se)
    assert abs(stats._t_tail(2.0, 10) - 0.0733880) < 1e-6 and abs(stats._t_tail(0.5, 3) - 0.6514) < 1e-3
    partial = stats.partial_r2(df, "y", ["a"], "b")
    base = stats.ols(df, "y", ["a"])["r2"]
    assert abs(partial - (fit["r2"] - base) / (1 - base)) < 1e-9


def test_curves(spark):
    x = np.arange(16.0, 31.0)
    y = 1 / (1 + np.exp(-0.6 * (x - 23)))
    assert abs(stats.child_age(x, y) - 23.0) < 1e-3
    assert stats.child_age(x[:2], y[:2]) is None and stats.child_age(x, y * 0) is None
    step = np.array([1e6 * k for k in (1, 2, 5, 10, 20, 50, 100, 200, 500)])
    s = 20 - 12 / (1 + np.exp(-3 * (np.log10(step + 1) - 7.2)))
    age = stats.model_age(step, s)
    assert age is not None and 6 < age < 8.7
    df = spark.createDataFrame([("w", float(a), float(b)) for a, b in zip(step, s)] + [("v", 1.0, None)], "word string, step double, surprisal double")
    got = {r.word: r.age for r in stats.ages(df, "word", "step", "surprisal").collect()}
    assert abs(got["w"] - age) < 1e-9


def test_similarity(spark):
    v = [(k, [float(x) for x in np.random.default_rng(k).normal(size=4)]) for k in range(7)]
    got = stats.cosine_pairs(spark.createDataFrame(v, "id long, v array<double>"), "id", "v", block=3).collect()
    m = np.array([x for _, x in v])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert len(got) == 21 and all(abs(r.cosine - m[r.i] @ m[r.j]) < 1e-9 for r in got)
    ranks = stats.average_ranks(spark.createDataFrame([(3.0,), (1.0,), (3.0,)], "x double"), "x", "r").collect()
    assert sorted(r.r for r in ranks) == [1.0, 2.5, 2.5]
    flat = stats.pearson(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), *map(__import__("pyspark.sql.functions", fromlist=["col"]).col, "ab"), empty=0.0).first()
    assert flat.r == 0.0


def test_tasks(spark):
    files = {"leaf": {"include": "base", "task": "leaf", "tag": "set"}, "base": {"include": "root", "num_fewshot": 3}, "root": {"num_fewshot": 0, "output_type": "multiple_choice"}, "loop": {"include": "loop"}}
    got = tasks.resolve("leaf", files.__getitem__)
    assert got == {"task": "leaf", "tag": "set", "num_fewshot": 3, "output_type": "multiple_choice"}
    with pytest.raises(ValueError):
        tasks.resolve("loop", files.__getitem__)
    configs = [{"task": "a", "tag": "x"}, {"task": "b", "tag": ["x", "y"]}, {"task": "c"}, {"group": "g", "task": ["x", {"task": "c"}]}, {"group": "all", "task": ["g"], "aggregate_metric_list": [{"metric": "acc", "weight_by_size": False}]}]
    closed = {(leaf, g) for leaf, g, _ in tasks.ancestors(configs)}
    assert closed == {("a", "g"), ("b", "g"), ("c", "g"), ("a", "all"), ("b", "all"), ("c", "all")}
    assert tasks.weights(configs) == {"g": False, "all": False}
    rows = spark.createDataFrame([("q", " p ")], "question string, passage string")
    assert rows.select(tasks.doc_to_text("{{passage.strip()}} Q: {{question}}", rows.columns)).first()[0] == "p Q: q"


def test_contexts_and_vocabulary(spark):
    df = spark.createDataFrame([(1, "The cat sat"), (2, "dog"), (3, ""), (4, "cat the")], "id long, s string")
    pairs = text.contexts(df, df.s, 1)
    assert sorted((r.ctx, r.word) for r in pairs.collect()) == [("cat", "sat"), ("cat", "the"), ("the", "cat")]
    vocabulary = spark.createDataFrame([("the",), ("cat",)], "word string")
    assert sorted(r.id for r in text.all_tokens_known(df, "id", df.s, vocabulary).collect()) == [3, 4]


def test_streaming(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyspark.streaming.incremental import remaining, run_available, totals

    schema = "revision string, uid string, correct int"
    count = lambda rows: rows.groupBy("revision", "uid").agg(F.count("*").alias("total"), F.sum("correct").alias("correct"))
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    write(tmp_path / "in/a.json", jsonl([{"revision": "1M", "uid": "u", "correct": 1}, {"revision": "1M", "uid": "u", "correct": 0}]))
    run_available(source, count, str(tmp_path / "out"), str(tmp_path / "state"))
    write(tmp_path / "in/b.json", jsonl([{"revision": "1M", "uid": "u", "correct": 1}, {"revision": "2M", "uid": "u", "correct": 1}]))
    run_available(source, count, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.revision, r.uid): (r.total, r.correct) for r in totals(spark, str(tmp_path / "out"), ["revision", "uid"]).collect()}
    assert got == {("1M", "u"): (3, 2), ("2M", "u"): (1, 1)}
    left = remaining(spark.createDataFrame([("1M",), ("3M",)], "revision string"), totals(spark, str(tmp_path / "out"), ["revision", "uid"]))
    assert [r.revision for r in left.collect()] == ["3M"]


def test_scorers_and_datasets(spark, tmp_path):
    from tallyspark.operators import progress, score
    from tallyspark.sources.datasets import dataset, steps

    c = spark.createDataFrame([(1, 0, "a", -1.0), (1, 1, "bb", float("nan"))], "item long, cand_idx int, sentence string, given double")
    assert [r.logprob for r in score.precomputed("given")(c).orderBy("cand_idx").collect()] == [-1.0, None]
    assert [r.logprob for r in score.batched(lambda b: -b["sentence"].str.len())(c).orderBy("cand_idx").collect()] == [-1.0, -2.0]
    assert all(r.logprob is None for r in score.batched(lambda b: 1 / 0)(c).collect())
    c.write.parquet(f"{tmp_path}/root/name/default/train.parquet")
    assert dataset(spark, f"{tmp_path}/root", "name", split="train").first().split == dataset(spark, f"{tmp_path}/root", "name").first().split == "train"
    paths = spark.createDataFrame([("/a/step/100",), ("/a/step/20/",), ("/a/step/final",)], "path string")
    assert [r.step for r in steps(paths).collect()] == [100, 20]
    logs = spark.createDataFrame([("r", e, m) for e, m in enumerate([0.1, 0.3, 0.3, 0.3005, 0.2, 0.9])], "run string, epoch int, acc double")
    assert progress.stopped_at(logs, ["run"], "epoch", "acc", patience=3).first().stop == 4
    assert [r.is_best for r in progress.best_so_far(logs, ["run"], "epoch", "acc").orderBy("epoch").collect()] == [True, True, False, True, False, True]


def test_unify(spark):
    from tallyspark.operators.unify import unify

    one = lambda rows, schema, kind, task="default": unify(spark.createDataFrame(rows, schema), kind, task).drop("idx").collect()
    got = one([("p ", "q", "a", "b", "c", "d", "2"), (None, "q", "a", "b", "c", "d", None)], "flores_passage string, question string, mc_answer1 string, mc_answer2 string, mc_answer3 string, mc_answer4 string, correct_answer_num string", "passage_choices")
    assert (got[0].sentence, got[0].label) == ("p\nq\nA: a\nB: b\nC: c\nD: d\n", "B") and got[1].label is None and got[1].sentence.startswith("\nq")
    got = one([("q", "a", "b", "c", "d", "3"), ("q", "a", "b", "c", "d", "B")], "question string, option_a string, option_b string, option_c string, option_d string, answer string", "option_columns")
    assert [r.label for r in got] == ["D", "B"] and got[0].sentence == "q\nA. a\nB. b\nC. c\nD. d\n"
    got = one([("q", "['it', \"is's\", 'a\\'b', 'd']", "C"), ("q", "broken", "A")], "question string, choices string, answer string", "option_text")
    assert got[0].sentence == "q\nA. it\nB. is's\nC. a'b\nD. d\n" and got[1].sentence == ""
    got = one([("p", "c1", "c2", "cause", 1), ("p", "c1", "c2", "effect", 0), ("p", "c1", "c2", "x", 0)], "premise string, choice1 string, choice2 string, question string, label int", "cause_effect")
    assert [(r.sentence1, r.sentence2) for r in got] == [("c1 p", "c2 p"), ("p c1", "p c2"), ("", "")] and got[0].label == "1"
    schema = "prompt string, choices array<string>, label string"
    got = one([("Premise: a\nb\nHypothesis: c d Question: e", ["x", "y"], "1"), ("none", ["x"], "5")], schema, "marked_pair")
    assert [(r.premise, r.hypothesis, r.label) for r in got] == [("a\nb", "c d", "y"), ("", "", None)]
    got = one([("Question: what?\nAnswer with A, B\nAnswer:", ["x", "y"], "0")], schema, "prompt_choices", "arc")
    assert got[0].sentence == "what?" and got[0].label == "x"
    with pytest.raises(NotImplementedError):
        unify(spark.range(1), "nothing")


def test_finetune(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyspark.operators import finetune as f

    assert f.text_roles(["idx", "premise", "hypothesis", "label"]) == (["premise"], "hypothesis", None)
    assert f.text_roles(["text", "label"]) == (["text"], None, None)
    assert f.text_roles(["answer", "paragraph", "question", "label"]) == (["question", "answer"], "paragraph", "Question: {} Answer: {}")
    assert f.text_roles(["span1_text", "span2_text", "text"])[1] == "text" and f.text_roles(["x", "sentence", "linguistic_feature_type"]) == (["sentence"], None, None)
    rows = spark.createDataFrame([("q", "a", "p", 1), ("q", None, "p", 0)], "question string, answer string, paragraph string, label int")
    got = f.classification_rows(rows, "multirc").collect()
    assert [(r.text, r.pair, r.label) for r in got] == [("Question: q Answer: a", "p", 1), (None, "p", 0)]
    assert f.classification_rows(rows.withColumnRenamed("question", "sentence"), "sst2", labelled=False).columns == ["text", "pair"]
    assert f.KEYS["xcopa"] == ("sentence1", "sentence2")
    with pytest.raises(NotImplementedError):
        f.classification_rows(rows, "nothing")
    with pytest.raises(ValueError):
        f.filled(["a"], "{} and {}")
    languages = f.codes(spark, {"en": "eng", "bg": "bul"}, {"en": "English"})
    entries = spark.createDataFrame([("sib200_eng_Latn",), ("sib200_bul_Cyrl",), ("sib200_x",), ("other_eng_Latn",), ("sib200_xyz_Latn",)], "entry string")
    scripts = {r.iso1: r.config for r in f.script_codes(entries, languages).collect()}
    assert scripts == {"en": "eng_Latn", "bg": "bul_Cyrl"}
    known = {"script": scripts, "iso3": {"en": "eng"}, "name": {"en": "English"}}
    assert f.dataset_config("Davlan/sib200", "en", known=known) == ("eng_Latn", {"sentence": "text", "label": "category", "idx": "index_id"})
    assert f.dataset_config("facebook/xnli", "de")[0] == "de" and f.dataset_config("CohereLabs/include-base-44", "en", known=known)[0] == "English"
    assert f.dataset_config("aialt/MuBench", "en", "mnli") == ("MNLIDataset_en_template_en", {"premise": "premise", "hypothesis": "hypothesis", "label": "label"})
    for bad in (("x/y", "en"), ("aialt/MuBench", "en", "x"), ("Davlan/sib200", "zz")):
        with pytest.raises(ValueError):
            f.dataset_config(*bad)
    assert f.with_roles(rows, {"sentence": "question"}).columns == ["sentence"]
    for name in ("train", "validation"):
        write(tmp_path / f"{name}.json", jsonl([{"a": name}]))
    got = f.local_dataset(spark, str(tmp_path / "train.json"), str(tmp_path / "validation.json")).collect()
    assert sorted((r.split, r.a) for r in got) == [("test", "validation"), ("train", "train"), ("validation", "validation")]
    with pytest.raises(ValueError):
        f.local_dataset(spark, "a.csv", "b.json")
    p = spark.createDataFrame([(0, 1.0), (1, 0.25)], "index long, prediction double")
    assert [r.prediction for r in f.prediction_lines(p).orderBy("index").collect()] == ["1.000", "0.250"]
    assert [r.prediction for r in f.prediction_lines(p, ["no", "yes"]).orderBy("index").collect()] == ["yes", "no"]
    assert f.result_lines({"accuracy": 0.5}) == ["accuracy: 0.5"]
    writers.write_lines(spark, f.result_lines({"accuracy": 0.5}), str(tmp_path / "r"))
    lines = spark.read.text(str(tmp_path / "r"))
    assert [(r.key, r.number) for r in report.percentages(report.key_values(lines)).collect()] == [("accuracy", 50.0)]
    assert f.flat_predictions(p, "boolq").select(F.max("uid")).first()[0] == "boolq"


def test_reading_report(spark, tmp_path):
    from tallyspark.operators import reading

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    pred = rng.normal(size=300)
    y = 1 + x @ [0.5, -1, 2] + x[:, 0] * x[:, 1] + 0.3 * pred + rng.normal(size=300)
    rows = [(*map(float, a), float(p), None if k % 10 == 3 else float(v), None if k % 17 == 5 else float(p)) for k, (a, p, v) in enumerate(zip(x, pred, y))]
    df = spark.createDataFrame(rows, "Subtlex_log10 double, length double, context_length double, whole double, RTgopast double, pred double")
    got = reading.powers(df, ["RTgopast"], reading.MAIN)[0]

    def fit(keep, extra):
        pairs = [x[:, 0] * x[:, 1], x[:, 0] * x[:, 2], x[:, 1] * x[:, 2]]
        design = np.column_stack([np.ones(300), x, *pairs, *([pred] if extra else [])])[keep]
        coef, rss = np.linalg.lstsq(design, y[keep], rcond=None)[:2]
        n, k = design.shape
        se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / (n - k))
        return coef[-1], coef[-1] / se[-1], 1 - rss[0] / ((y[keep] - y[keep].mean()) ** 2).sum(), 2 * k + n * (np.log(2 * np.pi) + np.log(rss[0] / n) + 1)

    number = np.arange(300)
    base, full = fit(number % 10 != 3, False), fit((number % 10 != 3) & (number % 17 != 5), True)
    assert np.allclose([got["coefficient"], got["t"], got["r2"], got["aic"]], full) and abs(got["delta_r2"] - (full[2] - base[2])) < 1e-9
    assert abs(got["delta_aic"] - (full[3] - base[3])) < 1e-6 and 0 <= got["p"] < 0.05 and abs(got["partial"] - (full[2] - base[2]) / (1 - base[2])) < 1e-9
    assert reading.eye_tracking_score([got]) == 100 * got["partial"] and reading.self_paced_score([{"measure": "self_x", "partial": 0.5}]) == 50
    lines = [r.value for r in reading.correlation_lines(df, ["RTgopast", "length"]).collect()]
    assert [v.split("\t")[0] for v in lines] == ["RTgopast", "length"]
    both = [(p, v) for *_, v, p in rows if v is not None and p is not None]
    assert float(lines[0].split("\t")[1]) == round(np.corrcoef(np.array(both).T)[0, 1], 4)
    assert reading.report_lines(1.234, 5) == ["EYE TRACKING SCORE: 1.23", "SELF-PACED READING SCORE: 5.00"]
    assert reading.table(spark, [got]).count() == 1 and len(reading.MEASURES) == 11 and len(reading.SPILLOVER) == 5
    named = spark.createDataFrame([(0, "s", "w", 1.0, None)], "index long, item string, word string, pred double, prev_pred double")
    assert reading.prediction_rows(named).columns == ["Index", "Sentence", "Word", "Logprob", "Prev_Logprob"]
    few = stats.pearson_p(spark.createDataFrame([(0.9, 2), (0.5, 12), (1.0, 5)], "r double, n long")).collect()
    assert (few[0].r, few[0].p) == (0.0, 1.0) and abs(few[1].p - 0.0978) < 1e-3 and few[2].p == 0


def test_completeness(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyspark.operators import complete
    from tallyspark.sources.datasets import found_results

    write(tmp_path / "run/1M/a/predictions.json", '{"u": 1}')
    expected = complete.expected_paths(spark, f"{tmp_path}/run", ["1M", "2M"], ["a", "b"])
    found = complete.listed(spark, f"{tmp_path}/run", "*.json")
    assert complete.missing_paths(expected, found).count() == 3
    assert {r.revision: (r.missing, r.valid) for r in complete.valid_revisions(expected, found).collect()} == {"1M": (1, False), "2M": (2, False)}
    read = lambda name, **how: complete.document_or_null(spark, f"{tmp_path}/run/1M/a/{name}", "u int", **how).first().document
    assert read("predictions.json").u == 1 and read("other.json") is None and read("predictions.json", good=lambda x: x["u"] > 1) is None
    assert complete.document_or_null(spark, f"{tmp_path}/nowhere/x.json", "u int").first().document is None
    assert not complete.all_complete(complete.step_check(spark.createDataFrame([("1M",)], "step string"), spark.createDataFrame([("1M",)], "step string"))).first().complete
    assert not complete.all_complete(spark.createDataFrame([], "complete boolean")).first().complete
    assert complete.available(spark.createDataFrame([("a",), ("b",)], "task string"), spark.createDataFrame([("a",)], "task string"), ["task"]).count() == 1
    paths = spark.createDataFrame([("/r/m/main/zero/causal/blimp/x/best_temperature_report.txt",), ("/r/m/main/finetune/rte/results.txt",), ("/r/a__b__m2/results_2.json",), ("/r/m/en/arc/all_results.json",)], "path string")
    assert tuple(found_results(paths, "best_temperature").first())[1:] == ("m", "zero", "blimp", "x")
    assert tuple(found_results(paths, "finetune").first())[1:] == ("m", "rte") and found_results(paths, "harness_of_model").first().model == "m2"
    assert tuple(found_results(paths, "all_results").first())[1:] == ("m", "en", "arc") and found_results(paths, "evaluation").count() == 0
    p = spark.createDataFrame([("u", 0, "x")], "uid string, seq long, pred string")
    fast = spark.createDataFrame([(1, {"u": 0.5}), (0, None)], "ord int, scores map<string,double>")
    assert json.loads("\n".join(r.value for r in writers.collated({"a": p, "b": None}, fast).collect())) == {"a": {"u": {"predictions": [{"id": "u_0", "pred": "x"}]}}, "b": None, "fast_eval_results": [None, {"u": 0.5}]}
    ages = stats.ages(spark.createDataFrame([("v", 1.0, None), ("v", 2.0, None)], "word string, step double, s double"), "word", "step", "s").first()
    assert (ages.word, ages.age) == ("v", None)
    wide = report.best_across(spark.createDataFrame([(1.0, 1.0), (None, 0.126), (None, None)], "a double, b double"), ["a", "b"]).collect()
    assert [(r.best, r.average) for r in wide] == [(["a", "b"], 1.0), (["b"], 0.13), ([], None)]
    tree = spark.createDataFrame([(0, 0.5), (1, 0.25), (1, None)], "depth int, acc double")
    assert report.subtasks(tree).count() == 1 and report.subtask_means(tree, ["depth"], "acc").count() == 2
    order = relate.in_order(spark.createDataFrame([("b",), ("z",), ("a",)], "m string"), "m", ["b", "a"]).orderBy("place").collect()
    assert [(r.m, r.place) for r in order] == [("b", 0), ("a", 1), ("z", 2)]
    left, right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "i int, x string"), spark.createDataFrame([(5, "p"), (4, "q")], "j int, y string")
    assert sorted((r.x, r.y) for r in relate.paired(left, right, ["i"], ["j"]).collect()) == [("a", "q"), ("b", "p")]
    assert found.select(F.max("path")).first()[0].endswith("predictions.json")


def test_task_layer(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyspark.operators import gold
    from tallyspark.sources.datasets import yaml_loader

    # two templates with one name: the include is that of the includer's folder
    files = {"a/leaf": {"include": "_base", "task": "x"}, "a/_base": {"include": "../root", "d": 1}, "b/leaf": {"include": "_base", "task": "y"}, "b/_base": {"d": 2}, "root": {"n": 0}}
    assert tasks.resolve("a/leaf", files.__getitem__) == {"task": "x", "d": 1, "n": 0} and tasks.resolve("b/leaf", files.__getitem__)["d"] == 2
    yaml = pytest.importorskip("yaml") if __import__("importlib").util.find_spec("yaml") else None
    write(tmp_path / "a/_t", "d: 1\nprocess_docs: !function utils.f\n")
    write(tmp_path / "b/_t", "d: 2\n")
    for k in "ab":
        write(tmp_path / f"{k}/leaf.yaml", f"include: _t\ntask: {k}\n")
    if yaml is not None:
        load = yaml_loader(str(tmp_path))
        assert tasks.resolve("a/leaf.yaml", load) == {"d": 1, "process_docs": "!function utils.f", "task": "a"} and tasks.resolve("b/leaf.yaml", load)["d"] == 2
        assert yaml.safe_load(tasks.group_text({"group": "g", "task": ["a", "b c"], "aggregate_metric_list": [{"metric": "acc", "weight_by_size": False}], "metadata": {"version": 1.0}})) == {"group": "g", "task": ["a", "b c"], "aggregate_metric_list": [{"metric": "acc", "weight_by_size": False}], "metadata": {"version": 1.0}}
    text_of = tasks.group_text({"group": "g: x", "task": ["a"], "n": True})
    assert text_of == 'group: "g: x"\ntask:\n- a\nn: true\n'
    config = {"task": "t", "doc_to_text": "{{q}}?", "doc_to_choice": "options", "doc_to_target": "label", "process_docs": {"kind": "k"}, "metric_list": [{"metric": "acc"}], "validation_split": "v", "training_split": "tr"}
    rows = spark.createDataFrame([("a", ["x", "y"], 1, "k"), ("b", ["x", "y"], 0, "other")], "q string, options array<string>, label int, kind string")
    got = tasks.prompted(rows, config).collect()
    assert [(r.prompt, r.choices, r.target, r.continuations) for r in got] == [("a?", ["x", "y"], 1, [" x", " y"])]
    assert tasks.split_of(config, "test") == "v" and tasks.split_of(config, "fewshot") == "tr" and tasks.split_of({}, "train") is None
    item = tasks.prompted(rows, config | {"doc_to_target": "{{options}}", "doc_to_choice": ["x", "{{q}}"], "process_docs": "!function f"}, functions={"f": {}}).collect()
    assert [r.choices for r in item] == [["x", "a"], ["x", "b"]] and [r.target for r in item] == [None, None]
    with pytest.raises(ValueError):
        tasks.choices_of({"task": "t"}, [])
    done = tasks.prompted(rows, config | {"process_docs": None}).withColumn("chosen", F.lit(1))
    m = tasks.measured(done, config).first()
    assert (m.acc, m["size"]) == (0.5, 2)
    with pytest.raises(NotImplementedError):
        tasks.metric("nothing")
    assert tasks.metric("wrong", lambda: F.lit(0.0)) is not None and "wrong" in tasks.METRICS
    made = tasks.generated({"en": ["a", "b"], "de": ["c"], "fr": ["zz"]}, {"a", "c"}, "g", True)
    assert [(c["group"], c["task"]) for c in made] == [("g_de", ["c"]), ("g_en", ["a"]), ("g", ["g_de", "g_en"])] and tasks.weights(made) == {"g_de": True, "g_en": True, "g": True}
    with pytest.raises(NotImplementedError):
        gold.gold_text("nothing")
    g = spark.createDataFrame([("good ", "p", "q", "comps_wugs_dist-in-between")], "sentence_good string, prefix_acceptable string, property_phrase string, stem string")
    assert tuple(g.select(gold.gold_text("minimal_pairs"), gold.gold_text("concept_pairs"), gold.subtask_of_file(F.col("stem"))).first()) == ("good ", "p q", "wugs_dist_in_between")
    j = spark.createDataFrame([("1M", "u", 1), ("1M", "u", 0), ("1M", "v", 1)], "revision string, uid string, correct int")
    axis = spark.createDataFrame([("2M", 1), ("1M", 0)], "revision string, ord int")
    assert [(r.revision, r.scores) for r in gold.fast_curve(j, axis).collect()] == [("1M", {"u": 0.5, "v": 1.0}), ("2M", None)]


def test_token_inputs(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, [5, 6, 7])], "id long, t array<int>")
    got = text.next_token_masked(rows, ["id"], F.col("t"), 0).orderBy("pos").collect()
    assert [(r.pos, r.target, r.input_ids, r.read_at) for r in got] == [(1, 6, [5, 0, 7], 0), (2, 7, [5, 6, 0], 1)]
    assert text.next_token_masked(rows, ["id"], F.col("t"), 0, prepend=9).count() == 3
    e = text.encoder_decoder(rows.withColumn("c", F.array(F.lit(8), F.lit(9))), ["id"], F.col("t"), F.col("c"), 100, 1).first()
    assert (e.encoder_ids, e.decoder_ids, e.labels) == ([5, 6, 7, 100], [1, 100, 8], [100, 8, 9])
    assert tuple(rows.select(text.padded(F.col("t"), 5, 0, left=True), text.padded(F.col("t"), 2, 0), text.attention(F.col("t"), 5)).first()) == ([0, 0, 5, 6, 7], [5, 6], [1, 1, 1, 0, 0])
    assert sorted(r.word for r in text.vocabulary(spark.createDataFrame([(" A",), ("a",), ("",), ("b",)], "value string")).collect()) == ["a", "b"]
    numbers = spark.createDataFrame([(float(k), k % 3, k) for k in range(500)] + [(None, 0, 7)], "x double, g int, n long")
    for by in ([], ["g"]):
        got = {r.x: r.s for r in stats.running_total(numbers.filter("x is not null"), ["x"], "n", "s", by, parts=7).collect()}
        assert all(got[float(k)] == sum(j for j in range(k + 1) if not by or j % 3 == k % 3) for k in range(500))
    assert stats.running_total(numbers.limit(0), ["x"], "n", "s").count() == 0
    split = relate.split_exactly(numbers.filter("x is not null"), ["x"], 0.25).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"valid": 125, "train": 375}


def test_context_frequencies_read_texts_once(spark):
    """Counts are made once and stored; neighbours are those of the general windows."""
    from tallyspark.operators import text

    df = spark.createDataFrame([("a b a b c",), ("a",), ("",), (None,), ("B a",)], "text string")
    pairs = text.contexts(df, F.col("text"), 1)
    assert sorted(map(tuple, pairs.collect())) == [("a", "b"), ("a", "b"), ("b", "a"), ("b", "a"), ("b", "c")]
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            seen.add(1)
            yield r

    counted = spark.createDataFrame(pairs.rdd.mapPartitions(count), "ctx string, word string")
    got = {(r.ctx, r.word): (r.n, r.frequency, r.ctx_n, r.ctx_frequency) for r in text.context_frequencies(counted).collect()}
    assert got == {("a", "b"): (2, 1.0, 2, 0.4), ("b", "a"): (2, 2 / 3, 3, 0.6), ("b", "c"): (1, 1 / 3, 3, 0.6)} and seen.value == 5
