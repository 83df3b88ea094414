"""Queries of the scoring pipeline: predictions against gold, the reading report, completeness, the task layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.folders import stored
from ..functions.scalars import hash_score, tokens
from ..operators import complete, finetune, gold, rank, reading, relate, report, routes, stats, tasks, templates, text
from .catalogue import TOK, H, query, r6, t


def _predictions(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    l = stored(t(spark, d, "lineitem").select(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("uid"), *order).distinct())
    right = hash_score(F.concat_ws("-", "l_orderkey", "l_linenumber")) < 0.7
    pred = rank.numbered(l, ["uid"], order).select("uid", "seq", F.when(right, F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit("\t"))).otherwise("wrong").alias("pred"))
    return stored(pred), l, order


@query("""WITH l AS (SELECT DISTINCT l_returnflag || '_' || l_linestatus AS uid, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), j AS (SELECT uid, CASE WHEN """ + H("l_orderkey || '-' || l_linenumber") + """ < 0.7 THEN 1 ELSE 0 END AS correct FROM l)
SELECT uid, count(*)::BIGINT AS total, sum(correct)::BIGINT AS correct, round(100.0::DOUBLE * sum(correct) / count(*), 6) AS accuracy FROM j GROUP BY 1""")
def q_gold_accuracy(spark, d):
    pred, l, order = _predictions(spark, d)
    return gold.scored(gold.judged(pred, l, order, F.col("l_partkey").cast("string"))).withColumn("accuracy", r6("accuracy"))


@query("""WITH l AS (SELECT DISTINCT l_returnflag || '_' || l_linestatus AS uid, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS seq FROM l),
j AS (SELECT uid, CASE WHEN """ + H("l_orderkey || '-' || l_linenumber") + """ < 0.7 THEN 1 ELSE 0 END AS correct FROM n WHERE seq < 700), c AS (SELECT uid, 100.0::DOUBLE * sum(correct) / count(*) AS a FROM j GROUP BY 1) SELECT round(avg(a), 6) AS macro, count(*)::BIGINT AS parts FROM c""")
def q_gold_truncated(spark, d):
    """Gold files that end early: the predictions beyond them count for nothing."""
    pred, l, order = _predictions(spark, d)
    short = stored(rank.numbered(l, ["uid"], order).filter("seq < 700").drop("seq"))
    return gold.score(gold.judged(pred, short, order, F.col("l_partkey").cast("string"))).select(r6("macro").alias("macro"), "parts")


@query("""WITH l AS (SELECT DISTINCT l_returnflag AS file, l_linenumber AS numops, l_orderkey, l_partkey, l_suppkey FROM lineitem), j AS (SELECT file || '_' || numops || '_ops' AS uid, CASE WHEN """ + H("l_orderkey || '-' || l_partkey") + """ < 0.4 THEN 1 ELSE 0 END AS correct FROM l)
SELECT uid, round(100.0::DOUBLE * sum(correct) / count(*), 6) AS accuracy FROM j GROUP BY 1""")
def q_gold_restart(spark, d):
    """Places start again in each run of rows with the same number of operations."""
    order = ["l_orderkey", "l_partkey", "l_suppkey"]
    l = stored(t(spark, d, "lineitem").select("l_returnflag", "l_linenumber", *order).distinct().withColumn("uid", gold.operations_uid(F.col("l_returnflag"), F.col("l_linenumber"))))
    right = hash_score(F.concat_ws("-", "l_orderkey", "l_partkey")) < 0.4
    pred = rank.numbered(l, ["uid"], order).select("uid", "seq", F.when(right, F.col("l_suppkey").cast("string")).otherwise("none").alias("pred"))
    return gold.scored(gold.judged(stored(pred), l, order, F.col("l_suppkey").cast("string"))).select("uid", r6("accuracy").alias("accuracy"))


@query(f"""WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, text) - 1 AS seq FROM conversations) SELECT role AS uid, role || '_' || seq AS id, CASE WHEN {H("role || '-' || seq")} < 0.5 THEN text ELSE ' none' END AS pred FROM c""")
def q_prediction_ids(spark, d):
    c = t(spark, d, "conversations").withColumn("uid", F.col("role")).withColumn("candidates", F.array(F.struct(F.lit("x").alias("sentence"), F.col("text").alias("completion")), F.struct(F.lit("y").alias("sentence"), F.lit(" none").alias("completion"))))
    items = c.select("uid", "conv_id", "turn", "text", "candidates")
    chosen = rank.numbered(items, ["uid"], ["conv_id", "turn", "text"]).select("uid", "seq", F.when(hash_score(F.concat_ws("-", "uid", "seq")) < 0.5, 0).otherwise(1).alias("chosen"))
    return gold.named(chosen, items, ["conv_id", "turn", "text"])


def _reading(spark, d):
    l = t(spark, d, "lineitem")
    noise = hash_score(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    return l.select((noise * 3).alias("Subtlex_log10"), F.col("l_quantity").cast("double").alias("length"), F.col("l_linenumber").cast("double").alias("context_length"), F.col("l_extendedprice").cast("double").alias("pred"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax").cast("double") * 100 + noise + F.col("l_extendedprice").cast("double") / 1e4).alias("RTfirstfix"), (F.col("l_discount").cast("double") * 10 + noise * F.col("l_quantity").cast("double")).alias("self_paced_reading_time"))


def _normal_equations() -> str:
    """R2 of two regressions in SQL: on one regressor, and on that and another, by their correlations."""
    h = H("l_orderkey || '-' || l_linenumber || '-' || l_partkey")
    return f"""WITH x AS (SELECT l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS p, CASE WHEN l_orderkey % 7 <> 0 THEN l_tax::DOUBLE * 100 + {h} + l_extendedprice::DOUBLE / 1e4 END AS y FROM lineitem),
c AS (SELECT corr(y, a) AS ya, corr(y, p) AS yp, corr(a, p) AS ap, count(*) AS n FROM x WHERE y IS NOT NULL),
r AS (SELECT n, ya * ya AS base, (ya * ya + yp * yp - 2 * ya * yp * ap) / (1 - ap * ap) AS full_r2 FROM c)
SELECT 'RTfirstfix' AS measure, round(full_r2, 6) AS r2, round(full_r2 - base, 6) AS delta_r2, round((full_r2 - base) / (1 - base), 6) AS partial, round(n * ln((1 - full_r2) / (1 - base)) + 2, 3) AS delta_aic, n::BIGINT AS n FROM r"""


@query(_normal_equations())
def q_reading_report(spark, d):
    """What a word's surprisal adds, on one other predictor: R2, its change, the partial R2 and the change in AIC."""
    found = reading.powers(_reading(spark, d), ["RTfirstfix"], ["length"])
    return reading.table(spark, found).select("measure", r6("r2").alias("r2"), r6("delta_r2").alias("delta_r2"), r6("partial").alias("partial"), F.round("delta_aic", 3).alias("delta_aic"), "n")


def _measures(spark, d):
    """Eleven measures, each missing elsewhere, and a prediction that some rows lack."""
    l = t(spark, d, "lineitem").withColumns({"noise": hash_score(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")), "base": F.col("l_tax").cast("double") * 100 + F.col("l_extendedprice").cast("double") / 1e4})
    values = [F.when(F.col("l_orderkey") % (7 + k) != 0, F.col("base") + F.col("noise") * (k + 1)).alias(m) for k, m in enumerate(reading.MEASURES)]
    return l.select(F.col("l_quantity").cast("double").alias("length"), F.col("l_linenumber").cast("double").alias("context_length"), F.when(F.col("l_orderkey") % 11 != 0, F.col("l_extendedprice").cast("double")).alias("pred"), *values)


def _orthogonal() -> str:
    """The same fits in SQL, by making each regressor orthogonal to those before it."""
    h = H("l_orderkey || '-' || l_linenumber || '-' || l_partkey")
    names = ", ".join(f"'{m}'" for m in reading.MEASURES)
    over = "OVER (PARTITION BY measure, fit)"
    less = lambda x, *e: x + "".join(f" - {v} * sum({x} * {v}) {over} / nullif(sum({v} * {v}) {over}, 0)" for v in e)
    return f"""WITH v AS (SELECT list_extract([{names}], k + 1) AS measure, k, l_quantity::DOUBLE AS a, l_linenumber::DOUBLE AS b, CASE WHEN l_orderkey % 11 <> 0 THEN l_extendedprice::DOUBLE END AS p,
CASE WHEN l_orderkey % (7 + k) <> 0 THEN l_tax::DOUBLE * 100 + l_extendedprice::DOUBLE / 1e4 + {h} * (k + 1) END AS y FROM lineitem, (SELECT unnest(range(0, 11)) AS k)),
x AS (SELECT 'base' AS fit, * FROM v WHERE y IS NOT NULL UNION ALL SELECT 'full', * FROM v WHERE y IS NOT NULL AND p IS NOT NULL),
c AS (SELECT measure, fit, y - avg(y) {over} AS y, a - avg(a) {over} AS e1, b - avg(b) {over} AS b, a * b - avg(a * b) {over} AS ab, p - avg(p) {over} AS p FROM x),
c2 AS (SELECT *, {less('b', 'e1')} AS e2 FROM c), c3 AS (SELECT *, {less('ab', 'e1', 'e2')} AS e3 FROM c2), c4 AS (SELECT *, {less('p', 'e1', 'e2', 'e3')} AS e4 FROM c3),
s AS (SELECT measure, fit, count(*) AS n, sum(y * y) AS yy, sum(y * e1) ^ 2 / sum(e1 * e1) + sum(y * e2) ^ 2 / sum(e2 * e2) + sum(y * e3) ^ 2 / sum(e3 * e3) AS part, sum(y * e4) AS ye, sum(e4 * e4) AS ee FROM c4 GROUP BY 1, 2),
f AS (SELECT measure, fit, n, yy, CASE WHEN fit = 'full' THEN part + ye ^ 2 / ee ELSE part END AS ess, ye / ee AS coefficient, ee, CASE WHEN fit = 'full' THEN 4 ELSE 3 END AS k FROM s),
g AS (SELECT *, ess / yy AS r2, n * (ln(2 * pi()) + ln((yy - ess) / n) + 1) + 2 * (k + 1) AS aic, coefficient / sqrt((yy - ess) / (n - k - 1) / ee) AS t FROM f)
SELECT u.measure, round(u.coefficient, 9) AS coefficient, round(u.t, 4) AS t, round(u.r2, 6) AS r2, round(u.r2 - b.r2, 6) AS delta_r2, round(u.aic - b.aic, 3) AS delta_aic, round((u.r2 - b.r2) / (1 - b.r2), 6) AS partial, u.n::BIGINT AS n FROM g u JOIN g b ON b.measure = u.measure AND b.fit = 'base' WHERE u.fit = 'full'"""


@query(_orthogonal())
def q_reading_measures(spark, d):
    """All eleven measures on two main effects, their product and the prediction, in two passes."""
    found = reading.table(spark, reading.powers(_measures(spark, d), reading.MEASURES, ["length", "context_length"]))
    return found.select("measure", F.round("coefficient", 9).alias("coefficient"), F.round("t", 4).alias("t"), *[r6(c).alias(c) for c in ("r2", "delta_r2", "partial")], F.round("delta_aic", 3).alias("delta_aic"), "n")


@query()
def q_reading_powers(spark, d):
    """The whole report: main effects, their products, coefficient, t, p, R2 and AIC of each measure; held against numpy in the tests."""
    return reading.table(spark, reading.powers(_reading(spark, d), ["RTfirstfix", "self_paced_reading_time"], reading.MAIN))


@query("""WITH s AS (SELECT DISTINCT event_type AS step FROM events), c AS (SELECT event_type AS step, count(*) AS found FROM events WHERE event_id % 10 <> 3 GROUP BY 1), e AS (SELECT step, 800 AS expected FROM s UNION ALL SELECT 'never', 800)
SELECT coalesce(e.step, c.step) AS step, coalesce(expected, 0)::BIGINT AS expected, coalesce(found, 0)::BIGINT AS found, coalesce(expected, 0) = coalesce(found, 0) AS complete FROM e FULL JOIN c ON e.step = c.step""")
def q_step_check(spark, d):
    e = t(spark, d, "events").withColumnRenamed("event_type", "step")
    steps = e.select("step").distinct().union(spark.sql("SELECT 'never' AS step"))
    return complete.step_check(e.filter("event_id % 10 <> 3"), steps, 800)


@query("""WITH e AS (SELECT label AS m, max(len(embedding)) AS k, count(*) AS n, sum(CASE WHEN vec_id % 100 = 17 THEN 1 ELSE 0 END) AS gaps FROM embeddings GROUP BY 1) SELECT m, n::BIGINT AS rows, k::BIGINT AS columns, gaps = 0 AS complete FROM e""")
def q_shape_check(spark, d):
    """Matrices of one row a vector: their shape, and whether every cell has a number."""
    e = t(spark, d, "embeddings")
    cells = rank.numbered(e, ["label"], ["vec_id"], "i").select(F.col("label").alias("m"), "i", "vec_id", F.posexplode("embedding").alias("j", "x")).select("m", "i", "j", F.when(~((F.col("vec_id") % 100 == 17) & (F.col("j") == 3)), F.col("x")).alias("value"))
    expected = e.groupBy(F.col("label").alias("m")).agg(F.count("*").alias("rows"), F.max(F.size("embedding")).cast("long").alias("columns"))
    return complete.shape_check(cells, "m", expected)


@query("""WITH e AS (SELECT DISTINCT '/r/' || source || '/' || lang || '/predictions.json' AS path, source AS revision FROM documents), x AS (SELECT s.revision, l.part, '/r/' || s.revision || '/' || l.part || '/predictions.json' AS path FROM (SELECT DISTINCT source AS revision FROM documents WHERE source IN ('src0', 'src3', 'src7')) s, (SELECT unnest(['en', 'de', 'xx']) AS part) l)
SELECT x.revision, count(*)::BIGINT AS files, sum(CASE WHEN e.path IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing, sum(CASE WHEN e.path IS NULL THEN 1 ELSE 0 END) = 0 AS valid FROM x LEFT JOIN e ON e.path = x.path GROUP BY 1""")
def q_expected_paths(spark, d):
    docs = t(spark, d, "documents")
    found = docs.select(F.concat(F.lit("/r/"), "source", F.lit("/"), "lang", F.lit("/predictions.json")).alias("path"))
    return complete.valid_revisions(complete.expected_paths(spark, "/r", ["src0", "src3", "src7"], ["en", "de", "xx"]), found)


CONFIG = {"task": "priority", "doc_to_text": "Order of {{o_orderstatus}}:", "doc_to_choice": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "doc_to_target": "o_orderpriority", "description": "How urgent?\n", "target_delimiter": " ", "process_docs": {"o_orderstatus": "F"}}


@query("""SELECT o_orderkey, 'How urgent?' || chr(10) || 'Order of ' || o_orderstatus || ':' AS prompt, substr(o_orderpriority, 1, 1)::INTEGER - 1 AS target, ' ' || o_orderpriority AS answer FROM orders WHERE o_orderstatus = 'F'""")
def q_task_prompts(spark, d):
    rows = tasks.prompted(t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), CONFIG)
    return rows.select("o_orderkey", "prompt", "target", F.get("continuations", F.col("target")).alias("answer"))


KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _part_configs() -> tuple[list[dict], dict[str, dict]]:
    """A family of configs as task folders have them: a filter by category each, named by function tags, and three forms of templates."""
    brands = [f"Brand#{k}" for k in range(1, 26)]
    functions = tasks.category_functions("p_brand", brands) | tasks.category_functions("p_type", KINDS, "kinds")
    pair = {"doc_to_text": "{{p_name.strip()}}\nAnswer:", "doc_to_choice": "{{[p_type, p_brand]}}", "doc_to_target": 0}
    kind = {"doc_to_text": "p_name", "doc_to_choice": [k.capitalize() for k in KINDS], "doc_to_target": "{{p_type|capitalize}}", "target_delimiter": "="}
    size = {"doc_to_text": "{{ 'big' if p_size > 25 else 'small' }} {{p_name}}", "doc_to_choice": ["a", "{{p_brand.split('#')[1]}}"], "doc_to_target": "a"}
    configs = [{"task": f"brand_{k + 1}", "process_docs": f"!function utils.process_brand#{k + 1}", "description": f"Of {b}. ", **pair} for k, b in enumerate(brands)]
    configs += [{"task": f"kind_{k.lower()}", "process_docs": f"!function 'kinds.process_{k.lower()}'", **kind} for k in KINDS]
    configs += [{"task": f"size_{n}_{k + 1}", "process_docs": {"p_size": n, "p_brand": b}, **size} for n in range(1, 51) for k, b in enumerate(brands)]
    return configs + [{"task": "all", **pair}], functions


@query("""WITH b AS (SELECT *, substr(p_brand, 7) AS b FROM part),
x AS (SELECT 'brand_' || b AS task, 'Of ' || p_brand || '. ' || trim(p_name) || chr(10) || 'Answer:' AS prompt, ' ' || p_type AS answer, 0 AS target FROM b
UNION ALL SELECT 'kind_' || lower(p_type), p_name, '=' || substr(p_type, 1, 1) || lower(substr(p_type, 2)), list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], p_type) - 1 FROM b
UNION ALL SELECT 'size_' || p_size || '_' || b, CASE WHEN p_size > 25 THEN 'big ' ELSE 'small ' END || p_name, ' a', 0 FROM b
UNION ALL SELECT 'all', trim(p_name) || chr(10) || 'Answer:', ' ' || p_type, 0 FROM b)
SELECT task, count(*)::BIGINT AS n, min(prompt) AS first_prompt, max(answer) AS last_answer, sum(target)::BIGINT AS targets FROM x GROUP BY 1""")
def q_config_routes(spark, d):
    """1,282 configs over one table in one scan: each row goes to the configs whose filters it passes."""
    configs, functions = _part_configs()
    rows = routes.prompted(t(spark, d, "part"), configs, functions)
    answer = F.get("continuations", F.col("target"))
    return rows.groupBy("task").agg(F.count("*").alias("n"), F.min("prompt").alias("first_prompt"), F.max(answer).alias("last_answer"), F.sum("target").alias("targets"))


TEMPLATE = "{{ 'closed' if o_orderstatus == 'F' and not o_totalprice < 1000 else o_orderstatus|lower }} {{o_orderpriority.split('-')[1].strip()|capitalize|replace('i', '!')}} {{[o_orderkey, o_custkey]|join('/')}}{{ ' ' + o_orderpriority if false else '' }}"


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND NOT o_totalprice < 1000 THEN 'closed' ELSE lower(o_orderstatus) END || ' ' || replace(upper(substr(split_part(o_orderpriority, '-', 2), 1, 1)) || lower(substr(split_part(o_orderpriority, '-', 2), 2)), 'i', '!') || ' ' || o_orderkey || '/' || o_custkey AS text FROM orders""")
def q_template_expressions(spark, d):
    rows = t(spark, d, "orders")
    return rows.select("o_orderkey", templates.text(TEMPLATE, rows.columns).alias("text"))


@query(f"""WITH c AS (SELECT lang || '/' || source AS leaf, lang, source, avg(CASE WHEN {H('doc_id')} < 0.6 THEN 1.0::DOUBLE ELSE 0 END) AS a, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
g AS (SELECT 'mean_' || lang AS task_group, avg(a) AS v, sum(n) AS n FROM c GROUP BY 1 UNION ALL SELECT 'mean', avg(a), sum(n) FROM c UNION ALL SELECT 'sized_' || lang, sum(a * n) / sum(n), sum(n) FROM c GROUP BY 1 UNION ALL SELECT 'sized', sum(a * n) / sum(n), sum(n) FROM c)
SELECT task_group, round(v, 6) AS value, n::BIGINT AS size FROM g""")
def q_group_rollup(spark, d):
    """Groups made by rule of the leaves that are there, weighted by size or not."""
    docs = t(spark, d, "documents").filter("lang is not null and source is not null")
    leaves = docs.groupBy("lang", F.concat_ws("/", "lang", "source").alias("leaf")).agg(F.avg((hash_score(F.col("doc_id")) < 0.6).cast("double")).alias("accuracy"), F.count("*").alias("size"))
    out = tasks.rollup_generated(leaves, F.col("lang"), "mean").unionByName(tasks.rollup_generated(leaves, F.col("lang"), "sized", True))
    return out.select("task_group", r6("value").alias("value"), "size")


@query("""SELECT p_partkey, 'Does "' || p_type || '" refer to "' || p_brand || '" in this passage?' AS text, p_name AS pair FROM part""")
def q_classification_text(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.col("p_type").alias("span2_text"), F.col("p_brand").alias("span1_text"), F.col("p_name").alias("text"))
    return finetune.classification_rows(rows, "wsc", labelled=False, carry=["p_partkey"])


@query(f"""WITH k AS (SELECT {TOK('lower(text)')} AS w FROM documents), p AS (SELECT w[i] AS ctx, w[i + 1] AS word FROM (SELECT w, unnest(range(1, len(w))) AS i FROM k WHERE len(w) > 1)), n AS (SELECT ctx, word, count(*) AS n FROM p GROUP BY 1, 2), c AS (SELECT ctx, sum(n) AS ctx_n FROM n GROUP BY 1), s AS (SELECT sum(n) AS total FROM n),
f AS (SELECT n.ctx, word, n, ctx_n, total FROM n JOIN c ON c.ctx = n.ctx, s)
SELECT ctx, count(*)::BIGINT AS words, any_value(ctx_n)::BIGINT AS ctx_n, round(max(n / ctx_n::DOUBLE), 6) AS top, round(any_value(ctx_n / total::DOUBLE), 9) AS share, round(any_value(log10(ctx_n / total::DOUBLE * 1e6)), 6) AS log_share FROM f GROUP BY 1""")
def q_context_frequencies(spark, d):
    docs = t(spark, d, "documents")
    f = text.context_frequencies(text.contexts(docs, F.col("text"), 1))
    return f.groupBy("ctx").agg(F.count("*").alias("words"), F.first("ctx_n").alias("ctx_n"), r6(F.max("frequency")).alias("top"), F.round(F.first("ctx_frequency"), 9).alias("share"), r6(F.first("ctx_log_per_million")).alias("log_share"))


@query(f"""WITH k AS (SELECT conv_id, turn, role, {TOK('text')} AS w, conv_id % 4 AS batch FROM conversations), o AS (SELECT *, sum(len(w)) OVER (PARTITION BY batch ORDER BY conv_id, turn, role, w ROWS UNBOUNDED PRECEDING) - len(w) AS b FROM k),
x AS (SELECT batch, b + i - 1 AS p, w[i] AS token FROM (SELECT batch, b, w, unnest(range(1, len(w) + 1)) AS i FROM o)), g AS (SELECT batch, p // 128 AS block, list(token ORDER BY p) AS ids FROM x GROUP BY 1, 2)
SELECT batch::BIGINT AS batch, block::BIGINT AS block, md5(array_to_string(ids, ' ')) AS ids FROM g WHERE len(ids) = 128""")
def q_token_blocks(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", "role", tokens(F.col("text")).alias("w"))
    out = text.blocks(c, ["conv_id", "turn", "role", "w"], "w", 128, F.col("conv_id") % 4)
    return out.select(F.col("batch").cast("long").alias("batch"), "block", F.md5(F.array_join("input_ids", " ")).alias("ids"))


@query(f"""WITH k AS (SELECT item_id, list_transform({TOK('text')}, lambda x: length(x)) AS w FROM benchmark) SELECT item_id, array_to_string(list_concat(w[1:12], list_transform(range(0, greatest(0, 12 - len(w))), lambda x: -1)), ' ') AS right_padded, least(12, len(w))::BIGINT AS n FROM k""")
def q_padded_tokens(spark, d):
    rows = t(spark, d, "benchmark").select("item_id", F.transform(tokens(F.col("text")), lambda x: F.length(x)).alias("w"))
    ones = text.attention(F.col("w"), 12, left=True)
    return rows.select("item_id", F.array_join(text.padded(F.col("w"), 12, -1), " ").alias("right_padded"), F.aggregate(ones, F.lit(0), lambda a, x: a + x).cast("long").alias("n"))


@query(f"""WITH p AS (SELECT DISTINCT lang AS word, source AS ctx FROM documents), r AS (SELECT word, ctx, row_number() OVER (PARTITION BY word ORDER BY {H("word || '|' || ctx || '|'")}, ctx) AS place FROM p WHERE word IN ('en', 'fr')) SELECT word, ctx, place::BIGINT AS place FROM r WHERE place <= 3""")
def q_random_contexts(spark, d):
    pairs = t(spark, d, "documents").select(F.col("lang").alias("word"), F.col("source").alias("ctx"))
    return text.random_contexts(pairs, spark.sql("SELECT explode(array('en', 'fr')) AS word"), 3).select("word", "ctx", "place")


@query("""WITH h AS (SELECT vec_id % 50 AS trial, vec_id % 3 AS age, abs(embedding[1]::DOUBLE) AS a, CASE WHEN vec_id % 5 > 0 THEN abs(embedding[2]::DOUBLE) END AS b FROM embeddings WHERE vec_id < 90), m AS (SELECT vec_id - 100 AS trial, abs(embedding[3]::DOUBLE) AS a, abs(embedding[4]::DOUBLE) AS b FROM embeddings WHERE vec_id BETWEEN 100 AND 140),
k AS (SELECT age, greatest(least(h.a, 1), 1e-10) AS p, greatest(least(coalesce(h.b, 0), 1), 1e-10) AS q, greatest(least(m.a, 1), 1e-10) AS r, greatest(least(m.b, 1), 1e-10) AS s FROM h JOIN m ON h.trial = m.trial)
SELECT age::BIGINT AS age, count(*)::BIGINT AS n, round(avg(p * ln(p / r) + q * ln(q / s)), 6) AS kl FROM k GROUP BY 1""")
def q_trial_ages(spark, d):
    """Each age bin of the human trials against all of the model's; trials that only one side has don't count."""
    e = t(spark, d, "embeddings")
    part = lambda k: F.abs(F.get("embedding", F.lit(k)).cast("double"))
    human = e.filter("vec_id < 90").select((F.col("vec_id") % 50).alias("trial"), (F.col("vec_id") % 3).cast("long").alias("age"), part(0).alias("image1"), F.when(F.col("vec_id") % 5 > 0, part(1)).alias("image2"))
    model = e.filter("vec_id between 100 and 140").select((F.col("vec_id") - 100).alias("trial"), part(2).alias("image1"), part(3).alias("image2"))
    both = relate.trials(human, model, ["image1", "image2"], ["age"])
    return both.groupBy("age").agg(F.count("*").alias("n"), r6(F.avg(stats.kl(F.col("human"), F.col("model")))).alias("kl"))


@query("""WITH r AS (SELECT *, ceil(0.2 * count(*) OVER ()) AS k, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS i FROM (SELECT DISTINCT doc_id FROM documents)) SELECT doc_id, CASE WHEN i <= k THEN 'valid' ELSE 'train' END AS split FROM r""")
def q_split_exactly(spark, d):
    return relate.split_exactly(t(spark, d, "documents").select("doc_id").distinct(), ["doc_id"])


@query("""WITH c AS (SELECT n_name AS row, round(avg(c_acctbal), 6) AS b, count(*)::DOUBLE AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) SELECT row, CASE WHEN b > n THEN 'b' WHEN n > b THEN 'n' ELSE 'b,n' END AS best FROM c""")
def q_best_across(spark, d):
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    wide = c.groupBy(F.col("n_name").alias("row")).agg(F.round(F.avg(F.col("c_acctbal").cast("double")), 6).alias("b"), F.count("*").cast("double").alias("n"))
    return report.best_across(wide, ["b", "n"]).select("row", F.array_join("best", ",").alias("best"))
