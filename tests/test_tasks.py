"""Task configs: template expressions, filters by function tags, many configs in one pass, JSON documents that aren't."""

from __future__ import annotations

import collections
import os

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import complete, routes, tasks, templates

SCHEMA = "question string, option_a string, option_b string, n int, words array<string>, info struct<lang:string,k:int>, tags map<string,string>, domain string, level int"
ROWS = [
    ("  Why?  ", "yes", "No", 3, ["a", "b", "c"], ("en", 1), {"k": "v"}, "STEM", 1),
    ("What", "x.y", "", -1, [], (None, 2), {}, "Arts & Humanities", 2),
    (None, "A", "B", None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize(
    "said, want",
    [
        ("{{question.strip()}}\nA. {{option_a}}\nB. {{option_b}}", ["Why?\nA. yes\nB. No", "What\nA. x.y\nB. ", None]),
        ("no place", ["no place"] * 3),
        ("", [""] * 3),
        ("{{option_a|upper}}-{{ option_b.lower() }}", ["YES-no", "X.Y-", "A-b"]),
        ("{{option_a.replace('.', '*')|capitalize}}", ["Yes", "X*y", "A"]),
        ("{{words[0]}}{{words[-1]}}", ["ac", None, None]),
        ("{{words|first}}:{{words|count}}", ["a:3", None, None]),
        ("{{words|join(' ')}}|", ["a b c|", "|", None]),
        ("{{info.lang}}{{info['k']}}", ["en1", None, None]),
        ("{{tags.k|default('none')}}", ["v", "none", "none"]),
        ("{{ 'many' if n > 2 else 'few' }}", ["many", "few", "few"]),
        ("{{ option_a if n == 3 or option_b == 'B' else 'other' }}", ["yes", "other", "A"]),
        ("{{ 'in' if option_a in ['yes', 'A'] else 'out' }}", ["in", "out", "in"]),
        ("{{ 'in' if 'b' in words else 'out' }}", ["in", "out", "out"]),
        ("{{ 'a' + option_a + 'b' }}", ["ayesb", "ax.yb", "aAb"]),
        ("{{ option_a.split('.')[0] }}", ["yes", "x", "A"]),
        ("{{ option_a.startswith('y') }}", ["true", "false", "false"]),
        ("{{ option_a.strip('ys') }}", ["e", "x.", "A"]),
        ("{{ option_a if not n < 0 else -1 }}", ["yes", "-1", "-1"]),
    ],
)
def test_templates(rows, said, want):
    assert [r[0] for r in rows.select(templates.text(said, rows.columns)).collect()] == want


@pytest.mark.parametrize("said", ["{{question", "question}}", "{% if n %}x{% endif %}", "{# note #}", "{{nothing}}", "{{question.format(1)}}", "{{question|shuffle}}", "{{__import__('os')}}", "{{question.strip(n)}}", "{{n + n}}", "{{'a' + option_a|upper}}", "{{lambda: 1}}", "{{question ~ option_a}}", "{{[x for x in words]}}", "{{}}", "{{question.replace('a')}}", "{{ {{n}} }}"])
def test_what_is_not_understood_is_an_error(rows, said):
    with pytest.raises(ValueError):
        templates.text(said, rows.columns)


def test_choices(rows):
    columns = rows.columns
    get = lambda said: [r[0] for r in rows.select(tasks.choices_of({"task": "t", "doc_to_choice": said}, columns)).collect()]
    assert get("{{[option_a, option_b]}}") == [["yes", "No"], ["x.y", ""], ["A", "B"]]
    assert get("{{[question.strip(), n]}}") == [["Why?", "3"], ["What", "-1"], [None, None]]
    assert get("words") == [["a", "b", "c"], [], None]
    assert get("{{words}}") == get("words") and get("{{option_a.split('.')}}") == [["yes"], ["x", "y"], ["A"]]
    assert get(["A", "{{option_b}}"]) == [["A", "No"], ["A", ""], ["A", "B"]]
    for said in ("[option_a, option_b]", "{{option_a}} {{option_b}}"):
        with pytest.raises(ValueError):
            get(said)


FUNCTIONS = tasks.category_functions("domain", ["STEM", "Arts & Humanities", "Health oriented education"])


def test_filters(rows):
    assert sorted(FUNCTIONS) == ["utils.process_arts_humanities", "utils.process_health_oriented_education", "utils.process_stem"]
    base = {"task": "t", "doc_to_text": "option_a", "doc_to_choice": ["x"], "doc_to_target": 0}
    take = lambda said, f=None: [r.option_a for r in tasks.prompted(rows, base | {"process_docs": said}, functions=f).collect()]
    assert take("!function utils.process_stem", FUNCTIONS) == ["yes"] and take("!function 'utils.process_arts_humanities'", FUNCTIONS) == ["x.y"]
    assert take(None) == ["yes", "x.y", "A"] and take({"level": 2, "domain": "Arts & Humanities"}) == ["x.y"] and take({"level": 1, "domain": "Arts & Humanities"}) == []
    for f in (None, {}, FUNCTIONS):
        with pytest.raises(ValueError):
            take("!function utils.process_other", f)


def configs():
    base = {"doc_to_text": "{{option_a}}?", "doc_to_choice": "{{[option_a, option_b]}}", "doc_to_target": 1}
    out = [{"task": name.split("_", 1)[1], "process_docs": f"!function {name}", "description": f"{name}: ", **base} for name in FUNCTIONS]
    out += [{"task": f"level_{k}_{d}", "process_docs": {"level": k, "domain": d}, "doc_to_text": "question", "doc_to_choice": ["yes", "x.y"], "doc_to_target": "{{option_a}}", "target_delimiter": "->"} for k in range(5) for d in ("STEM", "Arts & Humanities")]
    return out + [{"task": "only_level", "process_docs": {"level": 2}, **base}, {"task": "all", **base}]


@pytest.mark.parametrize("bound", [0, 20_000])
def test_routes_as_one_by_one(rows, monkeypatch, bound):
    monkeypatch.setattr(routes, "BROADCAST", bound)
    wide = rows.unionByName(rows)  # repeated rows
    names = ["task", "option_a", "prompt", "choices", "target", "continuations"]
    got = collections.Counter(map(str, routes.prompted(wide, configs(), FUNCTIONS).select(names).collect()))
    want = collections.Counter()
    for c in configs():
        want.update(map(str, tasks.prompted(wide, c, functions=FUNCTIONS).withColumn("task", F.lit(c["task"])).select(names).collect()))
    assert got == want and sum(got.values()) > 10


def test_routes_read_their_table_once(spark, tmp_path, rows):
    rows.drop("tags").write.parquet(str(tmp_path / "t"))
    plan = routes.prompted(spark.read.parquet(str(tmp_path / "t")), configs(), FUNCTIONS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_routes_refuse(rows):
    one = configs()[:1]
    for table, said, f in ((rows.withColumn("task", F.lit(1)), one, FUNCTIONS), (rows, one * 2, FUNCTIONS), (rows, one, None), (rows.drop("domain"), one, FUNCTIONS), (rows, [], FUNCTIONS)):
        with pytest.raises(ValueError):
            routes.prompted(table, said, f)
    assert routes.prompted(rows.filter("false"), configs(), FUNCTIONS).count() == 0


def test_every_shipped_template_compiles(spark):
    """The distinct templates of a task folder of thousands of configs."""
    columns = ["question", "option_a", "option_b", "option_c", "option_d", "text", "prompt", "sentence_good", "sentence_bad", "sen", "wrong_sen", "acceptable_sent", "unacceptable_sent", "label", "answer", "category", "choices"]
    df = spark.createDataFrame([tuple(columns)], ", ".join(f"{c} string" for c in columns))
    four = "{{question.strip()}}\nA. {{option_a}}\nB. {{option_b}}\nC. {{option_c}}\nD. {{option_d}}\nAnswer:"
    texts = [four, "prompt", "", "what category does the text: '{{text}}' belong to:"]
    assert [df.select(tasks.doc_to_text(x, columns)).first()[0] for x in texts] == ["question\nA. option_a\nB. option_b\nC. option_c\nD. option_d\nAnswer:", "prompt", "", "what category does the text: 'text' belong to:"]
    for pair in (["sentence_good", "sentence_bad"], ["sen", "wrong_sen"], ["acceptable_sent", "unacceptable_sent"]):
        assert df.select(tasks.choices_of({"doc_to_choice": "{{[" + ", ".join(pair) + "]}}"}, columns)).first()[0] == pair


def test_documents_that_are_no_json(spark, tmp_path):
    for name, said in (("good", '{"u": 1, "v": "x"}'), ("broken", '{"u": 1'), ("text", "nothing of the kind"), ("other", '{"u": "one"}'), ("empty", ""), ("list", "[1, 2]"), ("more", '{"u": 2, "w": [1]}')):
        with open(os.path.join(tmp_path, f"{name}.json"), "w") as f:
            f.write(said)
    get = lambda name, **how: complete.document_or_null(spark, f"{tmp_path}/{name}.json", "u int, v string", **how).first().document
    assert tuple(get("good")) == (1, "x") and tuple(get("more")) == (2, None)
    assert [get(n) for n in ("broken", "text", "other", "empty", "list", "absent")] == [None] * 6
    assert get("good", good=lambda d: d["u"] > 1) is None and get("text", good=lambda d: d["u"].isNull()) is None


def test_generated_groups_as_configs_say(spark):
    leaves = spark.createDataFrame([("a", "en", 0.5, 10), ("b", "en", 1.0, 30), ("c", "de", 0.25, 4), ("d", None, 0.9, 9)], "leaf string, lang string, accuracy double, size long")
    for by_size in (False, True):
        made = tasks.generated({"en": ["a", "b"], "de": ["c"]}, {"a", "b", "c"}, "g", by_size)
        want = {r.task_group: (round(r.value, 12), r["size"]) for r in tasks.rollup(leaves.filter("lang is not null"), [{"task": x} for x in "abc"] + made).collect()}
        got = {r.task_group: (round(r.value, 12), r["size"]) for r in tasks.rollup_generated(leaves, F.col("lang"), "g", by_size).collect()}
        assert got == want and set(got) == {"g", "g_en", "g_de"}


def test_one_file_is_many_tasks(spark, tmp_path):
    """Rows that lie in one file are dealt out before each becomes several."""
    spark.range(20_000).selectExpr("cast(id % 3 as string) as kind", "cast(id as string) as question").coalesce(1).write.parquet(str(tmp_path / "t"))
    made = [{"task": f"k{k}", "process_docs": {"kind": str(k)}, "doc_to_text": "question", "doc_to_choice": ["a", "b"], "doc_to_target": "a"} for k in range(3)]
    out = routes.prompted(spark.read.parquet(str(tmp_path / "t")), made)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 5000
