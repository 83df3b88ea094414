"""The jobs as registered queries, each beside its DuckDB counterpart.

A query runs its job twice, into one new folder of the shared one, and returns what is there after the second run. The files stay.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import collate_scores, word_contexts
from tallyspark.functions.folders import new_folder

HERE = os.path.dirname(os.path.abspath(__file__))
R6 = lambda c: F.round(F.col(c), 6).alias(c)


def settings(name: str) -> dict:
    with open(os.path.join(HERE, f"{name}.json"), encoding="utf-8") as f:
        return json.load(f)


def job1_collate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job1")
    for _ in range(2):
        collate_scores.run(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/orders.parquet", out, settings("collate_scores"))
    return collate_scores.output(spark, out).withColumns({"score": R6("score"), "coverage": R6("coverage")})


def job2_word_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job2")
    for _ in range(2):
        word_contexts.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out, settings("word_contexts"))
    return word_contexts.output(spark, out).withColumns({"frequency": R6("frequency"), "log_per_million": R6("log_per_million")})


SPACE = "[ \\t\\n\\r\\f\\x0b]+"
ORACLES = {
    "job1_collate_scores": """WITH p AS (SELECT 'model-' || (l_suppkey % 10) AS model, l_orderkey AS item, l_linestatus AS answer, row_number() OVER (PARTITION BY l_suppkey % 10, l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_linestatus DESC) AS r FROM lineitem WHERE l_suppkey IS NOT NULL AND l_orderkey IS NOT NULL),
g AS (SELECT o_orderkey AS item, o_orderpriority AS task, year(o_orderdate)::VARCHAR AS subtask, o_orderstatus AS answer FROM orders WHERE o_orderkey IS NOT NULL AND o_orderpriority IS NOT NULL),
s AS (SELECT task, subtask, count(*) AS total FROM g GROUP BY 1, 2), k AS (SELECT task, sum(total) AS total, count(*) AS parts FROM s GROUP BY 1),
u AS (SELECT g.task, g.subtask, p.model, any_value(s.total) AS total, count(*) AS answered, sum((trim(p.answer) = trim(g.answer))::INT) AS correct, sum((trim(p.answer) = trim(g.answer))::INT) / any_value(s.total)::DOUBLE AS score FROM p JOIN g ON p.item = g.item AND p.r = 1 JOIN s ON s.task = g.task AND s.subtask = g.subtask GROUP BY 1, 2, 3),
t AS (SELECT u.task, NULL AS subtask, model, any_value(k.total) AS total, sum(answered) AS answered, sum(correct) AS correct, sum(score) / any_value(parts) AS score FROM u JOIN k ON k.task = u.task GROUP BY 1, 3),
a AS (SELECT 'average' AS task, NULL AS subtask, model, (SELECT sum(total) FROM k) AS total, sum(answered) AS answered, sum(correct) AS correct, sum(score) / (SELECT count(*) FROM k) AS score FROM t GROUP BY 3),
n AS (SELECT task, subtask, total FROM s UNION ALL SELECT task, NULL, total FROM k UNION ALL SELECT 'average', NULL, sum(total) FROM k),
x AS (SELECT * FROM u UNION ALL SELECT * FROM t UNION ALL SELECT * FROM a UNION ALL SELECT task, subtask, NULL, total, 0, 0, NULL FROM n)
SELECT model, subtask, total::BIGINT AS total, answered::BIGINT AS answered, correct::BIGINT AS correct, round(score, 6) AS score, round(answered / total::DOUBLE, 6) AS coverage, answered = total AS complete, CASE WHEN model IS NOT NULL THEN (rank() OVER (PARTITION BY task, subtask ORDER BY round(score, 12) DESC NULLS LAST))::INTEGER END AS place, task FROM x""",
    "job2_word_contexts": f"""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(text), '{SPACE}')) AS word FROM benchmark) WHERE length(word) >= 2),
s AS (SELECT lang AS language, unnest(string_split(regexp_replace(text, '([.!?]){SPACE}', '\\1' || chr(30), 'g'), chr(30))) AS sentence FROM documents),
k AS (SELECT language, list_filter(string_split_regex(lower(sentence), '{SPACE}'), lambda x: x <> '') AS t FROM s), i AS (SELECT language, t, unnest(range(2, len(t) + 1)) AS i FROM k WHERE len(t) > 1),
x AS (SELECT language, t[i] AS word, array_to_string(t[greatest(1, i - 4):i - 1], ' ') AS ctx FROM i),
e AS (SELECT language, word, ctx, count(*) AS n FROM x WHERE word IN (SELECT word FROM w) GROUP BY 1, 2, 3), p AS (SELECT *, row_number() OVER (PARTITION BY language, word ORDER BY n DESC, ctx) AS place FROM e),
z AS (SELECT language, count(*) AS total FROM x GROUP BY 1), f AS (SELECT language, word, sum(n) AS n FROM e GROUP BY 1, 2)
SELECT language, word, ctx, n::BIGINT AS n, place::BIGINT AS place, 'context' AS kind, NULL::DOUBLE AS frequency, NULL::DOUBLE AS log_per_million FROM p WHERE place <= 10
UNION ALL SELECT f.language, word, NULL, n::BIGINT, NULL, 'word', round(n / total::DOUBLE, 6), round(log10(n / total::DOUBLE * 1e6), 6) FROM f JOIN z ON z.language IS NOT DISTINCT FROM f.language""",
}


def queries() -> dict:
    return {f.__name__: f for f in (job1_collate_scores, job2_word_contexts)}
