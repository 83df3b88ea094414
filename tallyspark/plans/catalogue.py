"""The catalogue of registered queries, each beside its DuckDB counterpart.

Queries apply the library's operators to the driver's tables, which stand in for task items, scores and
predictions. Floats are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_score, learning_rate, step_number, tokens
from ..operators import decode, ordinals, progress, rank, relate, report, revisions, score, sentences, stats, tasks, text

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if oracle is not None:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracles() -> dict:
    return dict(_ORACLES)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def H(x: str) -> str:
    """hash_score in DuckDB."""
    return f"(('0x' || substr(md5(CAST({x} AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0::DOUBLE)"


# ---- ranking ---------------------------------------------------------------------------------


def _pairs(spark, d) -> DataFrame:
    """Documents as minimal pairs: a document, and the next one of its language and source; scored by a surrogate."""
    docs = t(spark, d, "documents")
    s = (-hash_score(F.col("doc_id")) * F.col("n_chars")).alias("s")
    two = ordinals.with_next(docs.select("doc_id", "lang", "source", s), ["lang", "source"], ["doc_id"], {"other": "s"}).filter("other is not null")
    return two.withColumn("chosen", rank.choose_in_array(F.array("s", "other"))).withColumn("correct", (F.col("chosen") == 0).cast("int"))


PAIRS = f"""p AS (SELECT doc_id, lang, source, -{H('doc_id')} * n_chars AS s, lead(-{H('doc_id')} * n_chars) OVER (PARTITION BY lang, source ORDER BY doc_id) AS other FROM documents),
q AS (SELECT *, CASE WHEN s >= other THEN 1 ELSE 0 END AS correct FROM p WHERE other IS NOT NULL)"""


@query(f"""WITH {PAIRS}, c AS (SELECT 'lang' AS dimension, lang AS value, correct FROM q UNION ALL SELECT 'source', source, correct FROM q UNION ALL SELECT 'all', 'all', correct FROM q)
SELECT dimension, value, count(*)::BIGINT AS total, sum(correct)::BIGINT AS correct, round(100.0::DOUBLE * sum(correct) / count(*), 6) AS accuracy FROM c GROUP BY 1, 2""")
def q_rank_pairs_accuracy(spark, d):
    items = _pairs(spark, d).withColumn("all", F.lit("all"))
    return rank.accuracy(rank.counters(items, ["lang", "source", "all"])).withColumn("accuracy", r6("accuracy"))


@query(f"""WITH {PAIRS}, c AS (SELECT source, 100.0::DOUBLE * sum(correct) / count(*) AS a FROM q GROUP BY 1) SELECT round(avg(a), 6) AS macro, count(*)::BIGINT AS parts FROM c""")
def q_rank_macro_avg(spark, d):
    counted = rank.counters(_pairs(spark, d), ["source"])
    return rank.macro(counted).select(r6("macro").alias("macro"), "parts")


def _options(spark, d) -> DataFrame:
    """Orders as items, their lines as candidates; candidate 0 is right. The place of a line is by a total order."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = t(spark, d, "lineitem").select("l_orderkey", *order).repartition("l_orderkey").distinct()  # lines of an order, which are few, stay together: one shuffle
    return ordinals.numbered(lines, ["l_orderkey"], order, "cand_idx", parts=1).withColumn("logprob", -hash_score(F.concat_ws("-", "l_orderkey", "cand_idx")))


OPTIONS = f"""l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS cand_idx FROM l),
o AS (SELECT *, -{H("l_orderkey || '-' || cand_idx")} AS logprob FROM n),
w AS (SELECT l_orderkey, cand_idx AS chosen, logprob AS best_score, count(*) OVER (PARTITION BY l_orderkey) AS candidates, row_number() OVER (PARTITION BY l_orderkey ORDER BY logprob DESC, cand_idx) AS r FROM o)"""


@query(f"WITH {OPTIONS} SELECT l_orderkey, chosen::BIGINT AS chosen, round(best_score, 6) AS best_score, candidates::BIGINT AS candidates FROM w WHERE r = 1")
def q_rank_k_options(spark, d):
    return rank.choose(_options(spark, d), ["l_orderkey"]).withColumn("best_score", r6("best_score"))


@query(f"""WITH {OPTIONS}, j AS (SELECT substr(o_orderpriority, 1, 1) || '_' || candidates || '_ops' AS uid, CASE WHEN chosen = 0 THEN 1 ELSE 0 END AS correct FROM w JOIN orders ON o_orderkey = l_orderkey WHERE r = 1),
c AS (SELECT uid, 100.0::DOUBLE * sum(correct) / count(*) AS a FROM j GROUP BY 1), s AS (SELECT split_part(uid, '_', 1) AS split, avg(a) AS a FROM c GROUP BY 1)
SELECT round(avg(a), 6) AS macro, count(*)::BIGINT AS splits FROM s""")
def q_rank_two_level_macro(spark, d):
    best = rank.choose(_options(spark, d), ["l_orderkey"])
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    uid = F.concat_ws("_", F.substring("o_orderpriority", 1, 1), "candidates", F.lit("ops"))
    items = best.join(orders, "l_orderkey").select(uid.alias("uid"), (F.col("chosen") == 0).cast("int").alias("correct"))
    return rank.two_level_macro(rank.counters(items, ["uid"]), F.split("value", "_")[0]).select(r6("macro").alias("macro"), "splits")


@query(f"""WITH g AS (SELECT unnest([0.5, 1.0, 1.5, 2.0, 2.5])::DOUBLE AS temp), p AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS other FROM documents),
s AS (SELECT temp, -{H('doc_id')} / temp + {H("doc_id || '#'")} AS a, -{H('other')} / temp + {H("other || '#'")} AS b FROM p, g WHERE other IS NOT NULL),
c AS (SELECT temp, round(100.0::DOUBLE * sum(CASE WHEN a >= b THEN 1 ELSE 0 END) / count(*), 6) AS accuracy FROM s GROUP BY 1) SELECT temp, accuracy FROM c ORDER BY accuracy DESC, temp LIMIT 1""")
def q_rank_temperature_best(spark, d):
    docs = ordinals.with_next(t(spark, d, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], {"other": "doc_id"}).select("doc_id", "other")
    grid = docs.withColumn("temp", F.explode(F.array(*map(F.lit, (0.5, 1.0, 1.5, 2.0, 2.5)))))
    score = lambda c: -hash_score(F.col(c)) / F.col("temp") + hash_score(F.concat(F.col(c).cast("string"), F.lit("#")))
    items = grid.select("temp", (score("doc_id") >= score("other")).cast("int").alias("correct"))
    scored = items.groupBy("temp").agg(r6(100.0 * F.sum("correct") / F.count("*")).alias("accuracy"))
    return rank.best_setting(scored, "temp", "accuracy")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value) END AS s FROM events),
w AS (SELECT user_id, event_id AS chosen, coalesce(s, -1e300) AS s, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(s, -1e300) DESC, event_id) AS r, max(coalesce(s, -1e300)) OVER (PARTITION BY user_id) AS m FROM e)
SELECT user_id, max(CASE WHEN r = 1 THEN chosen END)::BIGINT AS chosen, sum(CASE WHEN s = m THEN 1 ELSE 0 END)::BIGINT AS ties, count(*)::BIGINT AS candidates FROM w GROUP BY 1""")
def q_rank_nan_ties(spark, d):
    nan = F.lit(float("nan"))
    e = t(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 == 0, nan).otherwise(F.round("value")).alias("s"))
    best = rank.choose(e, ["user_id"], "s", "event_id")
    return best.join(rank.tie_sizes(e, ["user_id"], "s"), "user_id").select("user_id", "chosen", "ties", "candidates")


@query(f"""WITH p AS (SELECT doc_id, lang, n_chars, lead(doc_id) OVER w AS o, lead(n_chars) OVER w AS m FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id)),
s AS (SELECT lang, -100 * {H('doc_id')} AS a, -100 * {H('o')} AS b, n_chars, m FROM p WHERE o IS NOT NULL AND n_chars > 0 AND m > 0)
SELECT lang, count(*)::BIGINT AS n, round(avg(CASE WHEN a >= b THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc, round(avg(CASE WHEN a / n_chars >= b / m THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc_norm FROM s GROUP BY 1""")
def q_acc_norm(spark, d):
    p = ordinals.with_next(t(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["lang"], ["doc_id"], {"o": "doc_id", "m": "n_chars"}).filter("n_chars > 0 and m > 0")
    a, b = -100 * hash_score(F.col("doc_id")), -100 * hash_score(F.col("o"))
    right = lambda x, y: F.avg((rank.choose_in_array(F.array(x, y)) == 0).cast("double"))
    return p.groupBy("lang").agg(F.count("*").alias("n"), r6(right(a, b)).alias("acc"), r6(right(a / F.col("n_chars"), b / F.col("m"))).alias("acc_norm"))


# ---- decoding --------------------------------------------------------------------------------


def _turns(spark, d) -> DataFrame:
    c = t(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return c.select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("next_text")).filter("next_text is not null")


TURNS = "u AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next_text FROM conversations), v AS (SELECT * FROM u WHERE next_text IS NOT NULL)"


@query(f"""WITH {TURNS}, x AS (SELECT role, text AS a, next_text AS b, 1 AS side FROM v UNION ALL SELECT role, next_text, text, 2 FROM v)
SELECT role AS uid, a || ' ' || 'T' || side AS first_sentence, b || ' ' || 'T' || side AS second_sentence, ' T' || side AS completion, 0::INTEGER AS label FROM x""")
def q_decode_swap_explode(spark, d):
    rows = _turns(spark, d).select(F.col("role").alias("Domain"), F.col("text").alias("Context1"), F.col("next_text").alias("Context2"), F.lit("T1").alias("Target1"), F.lit("T2").alias("Target2"), F.lit("direct").alias("ContextType"), F.lit("x").alias("ContextDiff"), F.lit("y").alias("TargetDiff"))
    return decode.decode("world_knowledge", rows).select("uid", F.col("candidates")[0]["sentence"].alias("first_sentence"), F.col("candidates")[1]["sentence"].alias("second_sentence"), F.col("candidates")[0]["completion"].alias("completion"), "label")


@query("""SELECT p_partkey, 4::BIGINT AS n_candidates, p_name || ' ' || p_brand AS gold, p_name || ' ' || p_type AS last FROM part""")
def q_decode_distractors(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("question"), F.col("p_brand").alias("target_ans"), F.array(F.lit("none"), F.col("p_size").cast("string"), F.col("p_type")).alias("distractors"))
    out = decode.decode("distractors", rows, carry=["p_partkey"])
    return out.select("p_partkey", F.size("candidates").cast("long").alias("n_candidates"), F.col("candidates")[0]["sentence"].alias("gold"), F.element_at("candidates", -1)["sentence"].alias("last"))


@query("""WITH x AS (SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN d.source ELSE 'q' || l.quality END AS uid, CASE WHEN l.quality IS NULL THEN 'supplement' ELSE d.lang END AS field FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id)
SELECT field, uid, count(*)::BIGINT AS n FROM x GROUP BY 1, 2""")
def q_schema_dispatch(spark, d):
    labels = t(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    j = t(spark, d, "documents").join(labels, "doc_id", "left")
    rows = j.select(F.lit("a").alias("sentence_good"), F.lit("b").alias("sentence_bad"), F.when(F.col("quality").isNotNull(), F.col("lang")).alias("field"), F.concat(F.lit("q"), F.col("quality")).alias("UID"), F.lit("x").alias("linguistics_term"), "source")
    out = decode.minimal_pairs(rows, F.col("source"))
    return out.groupBy(F.col("meta")["field"].alias("field"), "uid").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, 'Where is ' || n_name || '?' || chr(10) || 'A. ' || r_name || chr(10) || 'B. ' || 'nowhere' || chr(10) || 'C. ' || upper(r_name) || chr(10) || 'D. ' || lower(n_name) || chr(10) || 'Answer:' AS prompt, substr('ABCD', 1 + n_nationkey % 4, 1) AS answer FROM nation JOIN region ON n_regionkey = r_regionkey""")
def q_prompt_mc(spark, d):
    j = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    prompt = decode.multiple_choice(F.concat(F.lit("Where is "), F.col("n_name"), F.lit("?")), [F.col("r_name"), F.lit("nowhere"), F.upper("r_name"), F.lower("n_name")])
    return j.select("n_nationkey", prompt.alias("prompt"), decode.label_at(F.array(*map(F.lit, "ABCD")), F.col("n_nationkey") % 4).alias("answer"))


@query("""SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS label FROM events""")
def q_label_lookup_oob(spark, d):
    return t(spark, d, "events").select("event_id", decode.label_at(F.array(*map(F.lit, "ABC")), (F.col("user_id") % 5).cast("int")).alias("label"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""")
def q_clean_regex(spark, d):
    return t(spark, d, "pages").select("page_id", text.cleaned(F.col("html"), ["<script.*?</script>", "<[^>]*>"]).alias("text"))


@query(f"""WITH {TURNS} SELECT conv_id, turn, role, 'Question: ' || text || ' Answer: ' || next_text AS prompt FROM v""")
def q_template_text(spark, d):
    return _turns(spark, d).select("conv_id", "turn", "role", decode.template("Question: {q} Answer: {a}", q=F.col("text"), a=F.col("next_text")).alias("prompt"))


@query("""WITH i AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS label_id FROM (SELECT DISTINCT event_type FROM events)) SELECT i.event_type, label_id::INTEGER AS label_id, count(*)::BIGINT AS n FROM events e JOIN i ON e.event_type = i.event_type GROUP BY 1, 2""")
def q_label_to_id(spark, d):
    return decode.label_ids(t(spark, d, "events").select("event_type"), "event_type").groupBy("event_type", "label_id").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, swapped, CASE WHEN swapped THEN p_type ELSE p_brand END AS a, CASE WHEN swapped THEN p_brand ELSE p_type END AS b FROM part, (SELECT unnest([true, false]) AS swapped)""")
def q_pair_swap(spark, d):
    return decode.swapped(t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("a"), F.col("p_type").alias("b")), [("a", "b")]).select("p_partkey", "swapped", "a", "b")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || ' ' || o_orderpriority WHEN o_orderkey % 3 = 1 THEN o_orderpriority || ' ' || o_orderstatus ELSE '' END AS prompt FROM orders""")
def q_cause_effect(spark, d):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "cause").when(F.col("o_orderkey") % 3 == 1, "effect").otherwise("other")
    return t(spark, d, "orders").select("o_orderkey", decode.cause_effect(F.col("o_orderpriority"), F.col("o_orderstatus"), kind).alias("prompt"))


# ---- joins and sets ----------------------------------------------------------------------------


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, role, text) - 1 AS seq FROM (SELECT conv_id AS doc_id, turn, role, text FROM conversations)),
b AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) - 1 AS seq FROM labels) SELECT a.doc_id, a.seq::BIGINT AS seq, a.role, b.quality FROM a JOIN b ON a.doc_id = b.doc_id AND a.seq = b.seq""")
def q_positional_join(spark, d):
    c = t(spark, d, "conversations").withColumnRenamed("conv_id", "doc_id")
    return relate.positional(c, t(spark, d, "labels"), ["doc_id"], ["turn", "role", "text"], ["quality", "toxic"]).select("doc_id", "seq", "role", "quality")


@query("""WITH l AS (SELECT l_returnflag AS file, l_linenumber AS numops, l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY file, numops ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice) - 1 AS seq FROM l),
c AS (SELECT file, numops, 100.0::DOUBLE * sum(CASE WHEN (l_orderkey + seq) % 3 = 0 THEN 1 ELSE 0 END) / count(*) AS a FROM n GROUP BY 1, 2) SELECT round(avg(a), 6) AS macro, count(*)::BIGINT AS parts FROM c""")
def q_positional_restart(spark, d):
    l = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("file"), F.col("l_linenumber").alias("numops"), "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").distinct()
    n = rank.numbered(l, ["file", "numops"], ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"])
    items = n.select(F.concat_ws("_", "file", "numops").alias("uid"), ((F.col("l_orderkey") + F.col("seq")) % 3 == 0).cast("int").alias("correct"))
    return rank.macro(rank.counters(items, ["uid"])).select(r6("macro").alias("macro"), "parts")


@query("""WITH c AS (SELECT c_nationkey AS n_nationkey, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) SELECT n.n_nationkey, n_name, c_custkey, c_name FROM nation n JOIN c ON n.n_nationkey = c.n_nationkey WHERE r = 1""")
def q_first_match_join(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_name")
    return relate.first_match(t(spark, d, "nation").select("n_nationkey", "n_name"), c, ["n_nationkey"], ["c_custkey"])


TOK = lambda c: f"list_filter(string_split_regex({c}, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')"


@query(f"""WITH v AS (SELECT DISTINCT unnest({TOK('lower(text)')}) AS word FROM benchmark), w AS (SELECT doc_id, unnest({TOK('lower(text)')}) AS word FROM documents),
u AS (SELECT DISTINCT doc_id FROM w WHERE word NOT IN (SELECT word FROM v)) SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM u)""")
def q_vocab_filter_all_tokens(spark, d):
    vocabulary = t(spark, d, "benchmark").select(F.explode(tokens(F.lower("text"))).alias("word"))
    return text.all_tokens_known(t(spark, d, "documents"), "doc_id", F.col("text"), vocabulary).select("doc_id", "lang")


@query("""WITH e AS (SELECT n_nationkey, n_regionkey FROM nation), f AS (SELECT DISTINCT c_nationkey AS n_nationkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000),
s AS (SELECT DISTINCT n_regionkey FROM e JOIN f USING (n_nationkey)) SELECT n_regionkey, n_nationkey FROM e WHERE n_regionkey IN (SELECT n_regionkey FROM s) AND n_nationkey NOT IN (SELECT n_nationkey FROM f)""")
def q_semi_anti_completeness(spark, d):
    nation = t(spark, d, "nation").select("n_regionkey", "n_nationkey")
    big = t(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    found = t(spark, d, "customer").join(big, "c_custkey").select(F.col("c_nationkey").alias("n_nationkey")).distinct().join(nation, "n_nationkey")
    return relate.missing(nation, found.select("n_regionkey", "n_nationkey"), ["n_regionkey", "n_nationkey"], ["n_regionkey"])


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE)::VARCHAR AS revision FROM events), p AS (SELECT DISTINCT CAST(ts AS DATE)::VARCHAR AS revision FROM events WHERE event_type = 'error' AND value > 150) SELECT revision FROM d WHERE revision NOT IN (SELECT revision FROM p)""")
def q_resume_anti(spark, d):
    from ..streaming.incremental import remaining

    e = t(spark, d, "events").withColumn("revision", F.to_date("ts").cast("string"))
    return remaining(e.select("revision").distinct(), e.filter("event_type = 'error' and value > 150"))


@query("""WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS found FROM lineitem GROUP BY 1, 2), e AS (SELECT unnest(['A', 'N', 'R', 'X']) AS l_returnflag, unnest(['F', 'O', 'F', 'F']) AS l_linestatus, unnest([1000, 2000, 3000, 5]) AS expected)
SELECT coalesce(c.l_returnflag, e.l_returnflag) AS l_returnflag, coalesce(c.l_linestatus, e.l_linestatus) AS l_linestatus, coalesce(expected, 0)::BIGINT AS expected, coalesce(found, 0)::BIGINT AS found, coalesce(found, 0) = coalesce(expected, 0) AS complete FROM c FULL JOIN e ON c.l_returnflag = e.l_returnflag AND c.l_linestatus = e.l_linestatus""")
def q_size_check(spark, d):
    expected = spark.sql("SELECT * FROM VALUES ('A', 'F', 1000), ('N', 'O', 2000), ('R', 'F', 3000), ('X', 'F', 5) AS t(l_returnflag, l_linestatus, expected)")
    return relate.size_check(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], expected)


@query("""WITH w AS (SELECT user_id, event_type, ts, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id, round(value, 6) AS value FROM w WHERE r = 1""")
def q_merge_later_wins(spark, d):
    return relate.later_wins(t(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", r6("value").alias("value"))


@query("""SELECT DISTINCT doc_id FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents WHERE lang = 'de') ORDER BY 1""")
def q_union_splits(spark, d):
    return t(spark, d, "labels").select("doc_id").unionByName(t(spark, d, "documents").filter("lang = 'de'").select("doc_id")).distinct()


@query("""SELECT doc_id, 'gold' AS origin FROM labels UNION ALL SELECT doc_id, 'text' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_priority_union(spark, d):
    a = t(spark, d, "labels").select("doc_id", F.lit("gold").alias("origin"))
    return relate.priority_union(a, t(spark, d, "documents").select("doc_id", F.lit("text").alias("origin")), ["doc_id"])


@query("""SELECT n_nationkey, coalesce(c, 0)::BIGINT AS customers, coalesce(a, 0)::BIGINT AS rich FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c, sum(CASE WHEN c_acctbal > 9900 THEN 1 ELSE 0 END) AS a FROM customer GROUP BY 1) ON n_nationkey = c_nationkey""")
def q_missing_as_zero(spark, d):
    c = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.sum((F.col("c_acctbal") > 9900).cast("long")).alias("rich"))
    return relate.or_zero(t(spark, d, "nation").select("n_nationkey"), c, ["n_nationkey"], "customers").withColumn("rich", F.coalesce("rich", F.lit(0)))


@query("""SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)) LIMIT 100""")
def q_hash_sample(spark, d):
    return relate.sampled_exactly(t(spark, d, "documents").select("doc_id", "lang"), F.col("doc_id"), 100)


@query("""WITH w AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'valid' ELSE 'train' END AS split FROM w""")
def q_train_valid_split(spark, d):
    return relate.split_by_hash(t(spark, d, "documents").select("doc_id", "lang"), F.col("doc_id"), ["lang"])


@query("""WITH w AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) SELECT lang, doc_id, n_chars FROM w WHERE r <= 5""")
def q_fewshot_first_n(spark, d):
    return relate.first_n(t(spark, d, "documents").select("lang", "doc_id", "n_chars"), ["lang"], ["doc_id"], 5)


# ---- text ------------------------------------------------------------------------------------

NGRAM = f"""k AS (SELECT item_id, {TOK('lower(text)')} AS t FROM benchmark), i AS (SELECT t, unnest(range(2, len(t) + 1)) AS i FROM k WHERE len(t) > 1),
x AS (SELECT array_to_string(t[greatest(1, i - 2):i - 1], ' ') AS ctx, t[i] AS word FROM i)"""


def _contexts(spark, d) -> DataFrame:
    return text.contexts(t(spark, d, "benchmark"), F.col("text"), 2)


@query(f"WITH {NGRAM}, e AS (SELECT ctx, word, count(*) AS n FROM x GROUP BY 1, 2) SELECT ctx, word, n::BIGINT AS n, sum(n) OVER (PARTITION BY ctx)::BIGINT AS ctx_n FROM e")
def q_ngram_context_counts(spark, d):
    return text.context_counts(_contexts(spark, d))


@query(f"WITH {NGRAM}, e AS (SELECT word, count(*) AS n FROM x GROUP BY 1) SELECT word, n::BIGINT AS n, round(n / (sum(n) OVER ())::DOUBLE, 6) AS frequency, round(log10(n / (sum(n) OVER ())::DOUBLE * 1000000), 6) AS log_per_million FROM e")
def q_ngram_frequencies(spark, d):
    return text.word_frequencies(_contexts(spark, d)).select("word", "n", r6("frequency").alias("frequency"), r6("log_per_million").alias("log_per_million"))


@query(f"WITH {NGRAM} SELECT count(*)::BIGINT AS windows, count(DISTINCT ctx)::BIGINT AS contexts, count(DISTINCT word)::BIGINT AS words FROM x")
def q_ngram_metadata(spark, d):
    return _contexts(spark, d).agg(F.count("*").alias("windows"), F.countDistinct("ctx").alias("contexts"), F.countDistinct("word").alias("words"))


@query(f"""WITH {NGRAM}, tw AS (SELECT word FROM x GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 20), e AS (SELECT word, ctx, count(*) AS n FROM x WHERE word IN (SELECT word FROM tw) GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, ctx) AS place FROM e) SELECT word, ctx, n::BIGINT AS n, place::BIGINT AS place FROM w WHERE place <= 5""")
def q_topn_contexts(spark, d):
    pairs = _contexts(spark, d)
    words = pairs.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20)
    return text.top_contexts(pairs, words, 5)


@query(f"""WITH k AS (SELECT lower(t) AS t FROM (SELECT unnest({TOK('text')}) AS t FROM documents)), m AS (SELECT regexp_extract(t, '^["''‘“«(\\[]*(.*?)\\.["''’”»)\\]]*$', 1) AS s, regexp_extract(t, '^["''‘“«(\\[]*(.*?)[,;:!?"''’”»)\\]]*$', 1) AS b FROM k),
w AS (SELECT CASE WHEN regexp_full_match(s, '[\\p{{L}}.]*\\p{{L}}') THEN s END AS s, CASE WHEN regexp_full_match(b, '[\\p{{L}}.]*\\p{{L}}') THEN b END AS b FROM m),
c AS (SELECT coalesce(s, b) AS word, count(s)::DOUBLE AS a, count(*)::DOUBLE AS c FROM w WHERE coalesce(s, b) IS NOT NULL GROUP BY 1), t AS (SELECT least(greatest(sum(a) / sum(c), 1e-9), 1 - 1e-9) AS p FROM c),
z AS (SELECT word, a, c, -2 * (a * ln(p) + (c - a) * ln(1 - p) - a * ln(0.99::DOUBLE) - (c - a) * ln(0.01::DOUBLE)) AS ratio, length(replace(word, '.', '')) AS n FROM c, t WHERE a > 0)
SELECT word, a::BIGINT AS with_stop, (c - a)::BIGINT AS without, round(ratio * exp(-n) * (length(word) - n + 1) * power(n::DOUBLE, -(c - a)), 6) AS score FROM z""")
def q_sentence_abbreviations(spark, d):
    """How much each word before a full stop looks like an abbreviation, by the counts of the whole corpus."""
    return sentences.scored(sentences.word_counts(t(spark, d, "documents"), F.col("text"))).withColumn("score", r6("score"))


@query(f"""WITH k AS (SELECT conv_id, turn, role, string_split(text, ' ') AS p FROM (SELECT * FROM conversations) WHERE text IS NOT NULL), a AS (SELECT conv_id, turn, role, p, unnest(range(0, len(p))) AS pos FROM k),
s AS (SELECT conv_id, turn, role, pos, p[pos + 1] AS token, coalesce(list_sum(list_transform(p[1:pos], lambda x: length(x) + 1)), 0) AS char_start FROM a)
SELECT conv_id, turn, role, round(sum(CASE WHEN char_start + length(token) > 20 THEN {H('token')} END), 6) AS total, sum(CASE WHEN char_start + length(token) > 20 THEN 1 ELSE 0 END)::BIGINT AS n_tokens FROM s GROUP BY 1, 2, 3""")
def q_token_phrase_sum(spark, d):
    spans = text.token_table(t(spark, d, "conversations"), ["conv_id", "turn", "role"], F.col("text")).withColumn("s", hash_score(F.col("token")))
    return text.phrase_sum(spans, ["conv_id", "turn", "role"], F.lit(20), "s").withColumn("total", r6("total"))


@query(f"""WITH k AS (SELECT item_id, {TOK('text')} AS t FROM benchmark), a AS (SELECT item_id, t, unnest(range(0, len(t))) AS pos FROM k),
m AS (SELECT item_id, pos, t[pos + 1] AS target, array_to_string(list_concat(list_concat(t[1:pos], ['[MASK]']), t[pos + 2:]), ' ') AS masked FROM a) SELECT item_id, count(*)::BIGINT AS n, min(masked) AS least, max(target) AS most FROM m GROUP BY 1""")
def q_mask_expand(spark, d):
    rows = text.masked(t(spark, d, "benchmark"), ["item_id"], tokens(F.col("text")))
    return rows.groupBy("item_id").agg(F.count("*").alias("n"), F.min("masked").alias("least"), F.max("target").alias("most"))


@query(f"""WITH k AS (SELECT conv_id, turn, role, text, len({TOK('text')}) AS n FROM conversations), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn, role, text ROWS UNBOUNDED PRECEDING) AS e FROM k)
SELECT conv_id, turn, role, n::BIGINT AS n, e::BIGINT AS end_token, floor((e - n) / 512)::BIGINT AS first_block, floor((e - 1) / 512)::BIGINT AS last_block FROM s""")
def q_block_pack(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.size(tokens(F.col("text"))).cast("long").alias("n"), (F.col("conv_id") % 8).alias("shard"))
    return text.packed(rows, ["conv_id", "turn", "role", "text"], F.col("n"), 512, ["shard"]).select("conv_id", "turn", "role", "n", "end_token", "first_block", "last_block")


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(text, '\n+'), lambda s: s <> ''))::BIGINT AS n_lines FROM documents""")
def q_line_split(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n+"), lambda s: s != "")).cast("long").alias("n_lines"))


# ---- statistics ------------------------------------------------------------------------------


@query("""SELECT 'l_quantity' AS measure, round(corr(l_extendedprice, l_quantity), 6) AS r, count(*)::BIGINT AS n FROM lineitem UNION ALL SELECT 'l_discount', round(corr(l_extendedprice, l_discount), 6), count(*)::BIGINT FROM lineitem UNION ALL SELECT 'l_tax', round(corr(l_extendedprice, l_tax), 6), count(*)::BIGINT FROM lineitem""")
def q_reading_corr(spark, d):
    l = t(spark, d, "lineitem")
    long = l.select("l_extendedprice", F.explode(F.create_map(*[x for c in ("l_quantity", "l_discount", "l_tax") for x in (F.lit(c), F.col(c))])).alias("measure", "v"))
    return stats.pearson(long, F.col("l_extendedprice"), F.col("v"), ["measure"]).withColumn("r", r6("r"))


@query("""WITH b AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b, l_quantity * l_discount AS c, l_tax AS p FROM lineitem), m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(p) AS mp FROM b),
z AS (SELECT y - my AS y, a - ma AS a, b - mb AS b, c - mc AS c, p - mp AS p FROM b, m),
k1 AS (SELECT sum(y * a) / sum(a * a) AS y, sum(b * a) / sum(a * a) AS b, sum(c * a) / sum(a * a) AS c, sum(p * a) / sum(a * a) AS p FROM z), z1 AS (SELECT z.y - k1.y * a AS y, z.b - k1.b * a AS b, z.c - k1.c * a AS c, z.p - k1.p * a AS p FROM z, k1),
k2 AS (SELECT sum(y * b) / sum(b * b) AS y, sum(c * b) / sum(b * b) AS c, sum(p * b) / sum(b * b) AS p FROM z1), z2 AS (SELECT z1.y - k2.y * b AS y, z1.c - k2.c * b AS c, z1.p - k2.p * b AS p FROM z1, k2),
k3 AS (SELECT sum(y * c) / sum(c * c) AS y, sum(p * c) / sum(c * c) AS p FROM z2), z3 AS (SELECT z2.y - k3.y * c AS y, z2.p - k3.p * c AS p FROM z2, k3)
SELECT round(power(sum(y * p), 2) / (sum(y * y) * sum(p * p)), 6) AS partial_r2 FROM z3""")
def q_ols_partial_r2(spark, d):
    rows, columns = stats.with_interactions(t(spark, d, "lineitem"), ["l_quantity", "l_discount"])
    value = stats.partial_r2(rows, "l_extendedprice", columns, "l_tax")
    return spark.range(1).select(F.round(F.lit(value), 6).alias("partial_r2"))


@query("""WITH b AS (SELECT l_extendedprice AS y, l_quantity AS a, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS p FROM lineitem), c AS (SELECT * FROM b WHERE p IS NOT NULL),
m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(p) AS mp FROM c), z AS (SELECT y - my AS y, a - ma AS a, p - mp AS p FROM c, m), k AS (SELECT sum(y * a) / sum(a * a) AS y, sum(p * a) / sum(a * a) AS p FROM z), r AS (SELECT z.y - k.y * a AS y, z.p - k.p * a AS p FROM z, k)
SELECT round(power(sum(y * p), 2) / (sum(y * y) * sum(p * p)), 6) AS partial_r2, count(*)::BIGINT AS n FROM r""")
def q_ols_spillover(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    rows = t(spark, d, "lineitem").select("l_extendedprice", "l_quantity", F.lag("l_quantity").over(w).alias("previous")).dropna()
    value = stats.partial_r2(rows, "l_extendedprice", ["l_quantity"], "previous")
    return rows.agg(F.count("*").alias("n")).select(F.round(F.lit(value), 6).alias("partial_r2"), "n")


@query()
def q_ols_full_report(spark, d):
    rows, columns = stats.with_interactions(t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    fit = stats.ols(rows, "l_extendedprice", columns)
    return spark.createDataFrame([(c, float(a), float(b), float(p), fit["r2"], fit["aic"]) for c, a, b, p in zip(["intercept", *columns], fit["coef"], fit["t"], fit["p"])], "term string, coef double, t double, p double, r2 double, aic double")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id * 1e6 WHEN 1 THEN (doc_id + 0.5) * 1e3 WHEN 2 THEN doc_id * 1e9 WHEN 3 THEN doc_id END::DOUBLE AS step FROM documents""")
def q_step_parse(spark, d):
    """Names of checkpoints as training runs write them, one a document."""
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    name = F.when(k == 0, F.concat(F.lit("chck_"), i, F.lit("M"))).when(k == 1, F.concat(F.lit("step "), i, F.lit(".5k"))).when(k == 2, F.concat(i, F.lit("B words"))).when(k == 3, i).otherwise("none")
    return t(spark, d, "documents").select("doc_id", step_number(name).alias("step"))


@query("""SELECT event_type, CAST(ts AS DATE)::VARCHAR AS step, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY 1, 2""")
def q_surprisal_series(spark, d):
    e = t(spark, d, "events")
    return e.groupBy("event_type", F.to_date("ts").cast("string").alias("step")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.min("value")).alias("least"), r6(F.max("value")).alias("most"))


STEPS = [*range(1, 11), *range(20, 101, 10), *range(200, 1001, 100)]
CURVE = f"""k AS (SELECT p_partkey, 5 + 3 * {H("p_partkey || 'a'")} AS a, 3 + 3 * {H("p_partkey || 'b'")} AS b, 6.6 + 1.6 * {H("p_partkey || 'c'")} AS c, -16 + {H("p_partkey || 'd'")} AS d FROM (SELECT DISTINCT p_partkey FROM part)),
z AS (SELECT p_partkey, a, b, c, d, m * 1e6 AS step, ROW_NUMBER() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN p_partkey % 10 = 3 THEN -m ELSE m END) AS arrival FROM k, (SELECT unnest({STEPS}) AS m)),
y AS (SELECT *, a / (1 + exp(-b * (log10(step + 1) - c))) + d AS y FROM z)"""


def _curves(spark, d) -> DataFrame:
    """Noiseless learning curves of as many words as there are parts; every tenth arrives in the opposite order."""
    h = lambda x: hash_score(F.concat(F.col("p_partkey").cast("string"), F.lit(x)))
    words = t(spark, d, "part").select("p_partkey").distinct()
    at = words.withColumn("m", F.explode(F.array(*map(F.lit, STEPS)))).withColumn("step", F.col("m") * 1e6)
    value = (5 + 3 * h("a")) / (1 + F.exp(-(3 + 3 * h("b")) * (F.log10(F.col("step") + 1) - (6.6 + 1.6 * h("c"))))) + (-16 + h("d"))
    return at.select(F.col("p_partkey").cast("string").alias("word"), F.when(F.col("p_partkey") % 10 == 3, -F.col("m")).otherwise(F.col("m")).alias("arrival"), "step", (-value).alias("surprisal"))


@query(f"""WITH {CURVE}, w AS (SELECT p_partkey, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, (max(y) - log2(300000)) / 2 AS level, min(step) FILTER (arrival = 1) AS first, max(step) FILTER (arrival = {len(STEPS)}) AS last FROM y GROUP BY 1),
x AS (SELECT *, CASE WHEN d < level AND level < a + d THEN c - ln(a / (level - d) - 1) / b END AS found FROM w)
SELECT p_partkey::VARCHAR AS word, round(CASE WHEN first <= power(10, found) - 1 AND power(10, found) - 1 <= last THEN found END, 4) AS age FROM x""")
def q_aoa_curves(spark, d):
    """The ages that fits find on noiseless curves, against the curves' own."""
    found = stats.ages(_curves(spark, d), "word", "step", "surprisal", order=["arrival"])
    return found.withColumn("age", F.round("age", 4))


@query()
def q_aoa_fit(spark, d):
    """Fits of noisy series: each event a point of its own, in order of arrival."""
    e = t(spark, d, "events").select(F.col("event_type").alias("word"), "ts", "event_id", (F.dayofmonth("ts") * 1e6).alias("step"), (20 - F.dayofmonth("ts") / 2 + F.col("value") / 100).alias("surprisal"))
    return stats.ages(e, "word", "step", "surprisal", order=["ts", "event_id"])


@query("""WITH m AS (SELECT month(o_orderdate) AS month, o_orderpriority AS word, avg(o_totalprice) AS prop FROM orders GROUP BY 1, 2), w AS (SELECT word, avg(prop) AS mean, count(*) AS n FROM m GROUP BY 1) SELECT word, round(mean, 6) AS mean, n::BIGINT AS n FROM w""")
def q_month_means(spark, d):
    o = t(spark, d, "orders")
    wide = o.select(F.col("o_orderpriority").alias("word"), F.month("o_orderdate").alias("m"), "o_totalprice").groupBy("word").pivot("m", list(range(1, 13))).agg(F.avg("o_totalprice"))
    long = wide.unpivot(["word"], [F.col(f"`{k}`") for k in range(1, 13)], "month", "prop").filter("prop is not null")
    return long.groupBy("word").agg(r6(F.avg("prop")).alias("mean"), F.count("*").alias("n"))


CONFUSION = """c AS (SELECT lang, sum(CASE WHEN g = 1 AND p = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN g = 0 AND p = 1 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN g = 1 AND p = 0 THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN g = 0 AND p = 0 THEN 1 ELSE 0 END)::BIGINT AS tn FROM x GROUP BY 1)"""


@query(f"""WITH x AS (SELECT lang, quality AS g, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id), {CONFUSION}
SELECT lang, tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1,
round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc FROM c""")
def q_confusion_metrics(spark, d):
    x = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id")
    out = stats.confusion(x, F.col("quality"), (F.col("n_chars") > 1000).cast("int"), ["lang"])
    return out.withColumns({c: r6(c) for c in ("accuracy", "f1", "mcc")})


@query("""WITH m AS (SELECT avg(power(l_tax - 0.04, 2)) AS a, avg(power(l_discount - 0.05, 2)) AS b FROM lineitem) SELECT round(a, 6) AS mse_tax, round(b, 6) AS mse_discount, round((a + b) / 2, 6) AS combined FROM m""")
def q_mse_combined(spark, d):
    m = t(spark, d, "lineitem").agg(F.avg(F.pow(F.col("l_tax") - 0.04, 2.0)).alias("a"), F.avg(F.pow(F.col("l_discount") - 0.05, 2.0)).alias("b"))
    return m.select(r6("a").alias("mse_tax"), r6("b").alias("mse_discount"), r6((F.col("a") + F.col("b")) / 2).alias("combined"))


@query(f"""WITH {PAIRS}, l AS (SELECT lang, source, 1.0::DOUBLE * sum(correct) / count(*) AS a, count(*) AS n FROM q GROUP BY 1, 2), g AS (SELECT lang AS task_group, a, n FROM l UNION ALL SELECT 'all', a, n FROM l)
SELECT task_group, round(sum(a * n) / sum(n), 6) AS weighted, round(avg(a), 6) AS unweighted, sum(n)::BIGINT AS size FROM g GROUP BY 1""")
def q_weighted_rollup(spark, d):
    leaves = _pairs(spark, d).groupBy(F.concat_ws("/", "lang", "source").alias("leaf")).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count("*").alias("size"))
    langs, sources = ["en", "de", "fr", "es"], [f"src{k}" for k in range(20)]
    configs = [{"task": f"{x}/{s}", "tag": x} for x in langs for s in sources] + [{"group": x, "task": [x + "_tag"]} for x in langs] + [{"group": "all", "task": langs}]
    for c in configs:
        if "tag" in c:
            c["tag"] = c["tag"] + "_tag"
    out = rank.rollup_weighted(leaves, tasks.closure(spark, configs).select("leaf", "task_group"))
    return out.select("task_group", r6("weighted").alias("weighted"), r6("unweighted").alias("unweighted"), "size")


LOGITS = """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT vec_id, list_transform(v, lambda x: exp(2 * (x - list_max(v)))) AS x FROM e),
f AS (SELECT vec_id, list_transform(x, lambda y: y / list_sum(x)) AS q FROM s)"""


def _logits() -> Column:
    return F.transform("embedding", lambda x: x.cast("double"))


@query(f"WITH {LOGITS} SELECT vec_id, k::INTEGER AS k, round(q[k + 1], 6) AS p FROM (SELECT vec_id, q, unnest(range(0, len(q))) AS k FROM f)")
def q_softmax_beta(spark, d):
    p = stats.softmax(_logits(), 2.0)
    return t(spark, d, "embeddings").select("vec_id", F.posexplode(p).alias("k", "p")).withColumn("p", r6("p"))


@query(f"""WITH {LOGITS} SELECT round(avg(list_sum(list_transform(q, lambda v: ln(1 / len(q) / greatest(1e-10, v)) / len(q)))), 6) AS mean_kl, count(*)::BIGINT AS trials FROM f""")
def q_kl_trials(spark, d):
    human = F.transform("embedding", lambda x: F.lit(1.0) / F.size("embedding"))
    return t(spark, d, "embeddings").agg(r6(F.avg(stats.kl(human, stats.softmax(_logits(), 2.0)))).alias("mean_kl"), F.count("*").alias("trials"))


GRID = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_sum(range(1, len(embedding) + 1))::DOUBLE AS n FROM embeddings), g AS (SELECT vec_id, v, n, unnest({GRID})::DOUBLE AS beta FROM e),
s AS (SELECT vec_id, n, beta, list_transform(v, lambda x: exp(beta * (x - list_max(v)))) AS x FROM g), k AS (SELECT beta, avg(list_sum(list_transform(range(1, len(x) + 1), lambda i: i / n * ln(i / n / greatest(1e-10, x[i] / list_sum(x)))))) AS kl FROM s GROUP BY 1)
SELECT beta, round(kl, 6) AS kl FROM k ORDER BY kl, beta LIMIT 1""")
def q_beta_grid(spark, d):
    """The best of a fixed grid of inverse temperatures, human shares growing with the place."""
    total = F.size("embedding").cast("double") * (F.size("embedding") + 1) / 2
    human = F.transform("embedding", lambda x, i: (i + 1).cast("double") / total)
    best = stats.best_beta(t(spark, d, "embeddings").select(_logits().alias("logits"), human.alias("human")), "human", "logits", grid=GRID)
    return spark.createDataFrame([(best["beta"], round(best["kl"], 6))], "beta double, kl double")


@query()
def q_beta_search(spark, d):
    """The same by search; held against a fine scan in the tests."""
    total = F.size("embedding").cast("double") * (F.size("embedding") + 1) / 2
    human = F.transform("embedding", lambda x, i: (i + 1).cast("double") / total)
    best = stats.best_beta(t(spark, d, "embeddings").select(_logits().alias("logits"), human.alias("human")), "human", "logits")
    return spark.createDataFrame([(round(best["beta"], 4), round(best["kl"], 6))], "beta double, kl double")


@query("""SELECT label, round(avg(CASE WHEN embedding[1] > list_max(embedding[2:]) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, count(*)::BIGINT AS n FROM embeddings GROUP BY 1""")
def q_choice_strict(spark, d):
    e = F.col("embedding")
    rest = F.array_max(F.slice(e, F.lit(2), F.greatest(F.size(e) - 1, F.lit(0))))
    return t(spark, d, "embeddings").groupBy("label").agg(r6(F.avg((e[0] > rest).cast("double"))).alias("accuracy"), F.count("*").alias("n"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), p AS (SELECT a.vec_id AS i, list_cosine_similarity(a.x, b.x) AS c FROM v a JOIN v b ON a.vec_id > b.vec_id) SELECT i, count(*)::BIGINT AS n, round(max(c), 6) AS nearest, round(avg(c), 6) AS mean FROM p GROUP BY 1""")
def q_cosine_pairs(spark, d):
    return stats.cosine_summary(t(spark, d, "embeddings"), "vec_id", "embedding").withColumns({"nearest": r6("nearest"), "mean": r6("mean")})


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS x, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS y FROM embeddings), p AS (SELECT round(list_cosine_similarity(a.x, b.x), 4) AS s, round(list_cosine_similarity(a.y, b.y), 4) AS t FROM v a JOIN v b ON a.vec_id > b.vec_id),
r AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0::DOUBLE AS b FROM p) SELECT round(corr(a, b), 4) AS rho, count(*)::BIGINT AS n FROM r""")
def q_rsa_spearman(spark, d):
    """The two halves of the vectors as two models: the rank correlation of their similarity matrices."""
    e = t(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"))
    return stats.matrix_rank_correlation(e, "vec_id", "x", "y", 4).select(F.round("rho", 4).alias("rho"), "n")


@query("""WITH v AS (SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN round(value) END AS x FROM events), r AS (SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY x) + (count(*) OVER (PARTITION BY event_type, x) - 1) / 2.0::DOUBLE AS r FROM v WHERE x IS NOT NULL) SELECT event_id, r AS rank FROM v LEFT JOIN r USING (event_id)""")
def q_average_ranks(spark, d):
    """Ranks with ties within each type of event; events without a value have none."""
    rows = t(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.round("value")).alias("x"))
    return stats.average_ranks(rows, "x", "rank", ["event_type"]).select("event_id", "rank")


@query("""WITH p AS (SELECT label, unnest(range(0, 64)) AS pos, embedding FROM embeddings) SELECT label, pos::INTEGER AS pos, round(avg(embedding[pos + 1]::DOUBLE), 6) AS mean FROM p GROUP BY 1, 2""")
def q_mean_pool(spark, d):
    return stats.mean_vector(t(spark, d, "embeddings"), ["label"], "embedding").withColumn("mean", r6("mean"))


# ---- reports ---------------------------------------------------------------------------------

@query("""WITH c AS (SELECT conv_id, turn, min(role) AS role, max(length(text)) / 100.0::DOUBLE AS acc FROM conversations GROUP BY 1, 2)
SELECT c.conv_id, c.turn, c.turn % 3 AS depth, c.role || c.turn AS name, (SELECT x.role || x.turn FROM c x WHERE x.conv_id = c.conv_id AND x.turn <= c.turn AND x.turn % 3 = 0 ORDER BY x.turn DESC LIMIT 1) AS task, round(c.acc, 6) AS acc FROM c""")
def q_alias_tree(spark, d):
    """Conversations as indented reports: a turn's indent says how deep its row stands."""
    rows = t(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), (F.max(F.length("text")) / 100.0).alias("acc"))
    named = rows.withColumn("alias", F.concat(F.repeat(F.lit(" "), (F.col("turn") % 3).cast("int")), "role", F.col("turn").cast("string")))
    return report.alias_tree(named, ["conv_id"], "turn", "alias", "acc").withColumn("acc", r6("acc"))


@query("""WITH c AS (SELECT source, lang, avg(n_chars) AS v FROM documents GROUP BY 1, 2), p AS (SELECT source, max(CASE WHEN lang = 'en' THEN v END) AS en, max(CASE WHEN lang = 'de' THEN v END) AS de, max(CASE WHEN lang = 'fr' THEN v END) AS fr, max(CASE WHEN lang = 'es' THEN v END) AS es FROM c GROUP BY 1)
SELECT source, round(en, 6) AS en, round(de, 6) AS de, round(fr, 6) AS fr, round(es, 6) AS es, round((coalesce(en, 0) + coalesce(de, 0) + coalesce(fr, 0) + coalesce(es, 0)) / ((en IS NOT NULL)::INT + (de IS NOT NULL)::INT + (fr IS NOT NULL)::INT + (es IS NOT NULL)::INT), 6) AS average, en = max(en) OVER () AS en_best FROM p""")
def q_pivot_best(spark, d):
    langs = ["en", "de", "fr", "es"]
    means = t(spark, d, "documents").groupBy("source", "lang").agg(F.avg("n_chars").alias("v"))
    wide = report.pivoted(means, "source", "lang", "v", langs)
    marked = report.best_marked(wide.withColumn("one", F.lit(1)), ["one"], "en")
    return marked.select("source", *[r6(c).alias(c) for c in langs], r6("average").alias("average"), F.when(F.col("en").isNotNull(), F.col("is_best")).alias("en_best"))


@query("""WITH m AS (SELECT DISTINCT source, lang FROM documents), n AS (SELECT CASE lang WHEN 'en' THEN source || '-Strict' WHEN 'de' THEN source || '-lm-nld' WHEN 'fr' THEN 'x-en_nld_equal-' || source WHEN 'es' THEN 'nld_zho_' || source ELSE source END AS model,
CASE lang WHEN 'en' THEN ['eng'] WHEN 'de' THEN ['nld'] WHEN 'fr' THEN ['eng', 'nld'] WHEN 'es' THEN ['nld', 'zho'] ELSE [] END AS languages, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 3 WHEN 'es' THEN 5 ELSE 7 END AS place FROM m)
SELECT model, array_to_string(languages, '+') AS languages, place::INTEGER AS place FROM n""")
def q_model_order(spark, d):
    """Models by the languages that their names tell: single ones first, then pairs, then those that tell none."""
    source = F.col("source")
    name = F.when(F.col("lang") == "en", F.concat(source, F.lit("-Strict"))).when(F.col("lang") == "de", F.concat(source, F.lit("-lm-nld"))).when(F.col("lang") == "fr", F.concat(F.lit("x-en_nld_equal-"), source)).when(F.col("lang") == "es", F.concat(F.lit("nld_zho_"), source)).otherwise(source)
    rows = t(spark, d, "documents").select("source", "lang").distinct().select(name.alias("model"))
    return relate.by_languages(rows, "model").select("model", F.array_join("languages", "+").alias("languages"), "place").orderBy("place", "model")


@query("""WITH r AS (SELECT unnest(list_concat(range(1, 10), list_concat(range(10, 101, 10), range(200, 1001, 100)))) AS m), a AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS ord FROM r), e AS (SELECT day(ts) - 1 AS ord, avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END) AS a, count(*) AS n FROM events GROUP BY 1)
SELECT a.ord::INTEGER AS ord, 'chck_' || m || 'M' AS revision, (m * 1000000)::BIGINT AS word_count, round(e.a, 6) AS accuracy, coalesce(n, 0)::BIGINT AS n FROM a LEFT JOIN e ON a.ord = e.ord""")
def q_revision_fast_curve(spark, d):
    e = t(spark, d, "events").groupBy((F.dayofmonth("ts") - 1).alias("ord")).agg(r6(F.avg((F.col("value") > 50).cast("double"))).alias("accuracy"), F.count("*").alias("n"))
    return revisions.axis(spark).join(e, "ord", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS model, regexp_extract(url, '^[a-z]+://[^/?#]*/([a-z]+)/', 1) AS lang, regexp_extract(url, '/([0-9]+)', 1) AS task FROM pages""")
def q_path_keys(spark, d):
    u = F.col("url")
    return t(spark, d, "pages").select("page_id", F.regexp_extract(u, "^[a-z]+://([^/?#]*)", 1).alias("model"), F.regexp_extract(u, "^[a-z]+://[^/?#]*/([a-z]+)/", 1).alias("lang"), F.regexp_extract(u, "/([0-9]+)", 1).alias("task"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_acctbal WHEN 3 THEN c_custkey END::DOUBLE AS score FROM customer")
def q_report_parse(spark, d):
    """Text reports, one a customer: whole ones, ones without a number, ones without the section."""
    k, number = F.col("c_custkey") % 4, F.col("c_acctbal").cast("string")
    text_of = F.when(k == 0, F.concat(F.lit("TEMPERATURE: 1.0\n### UID ACCURACY\na: 1\n### AVERAGE ACCURACY\n"), number, F.lit("\n"))).when(k == 1, "### AVERAGE\nnone").when(k == 2, F.concat(F.lit("nothing "), number))
    text_of = text_of.otherwise(F.concat(F.lit("  ### AVERAGE of all\n  "), F.col("c_custkey").cast("string"), F.lit("\n### AVERAGE\n7")))
    return t(spark, d, "customer").select("c_custkey", report.average_score(text_of).alias("score"))


@query("""SELECT event_type AS key, count(*)::BIGINT AS lines, count(CASE WHEN event_id % 3 = 0 THEN 1 END)::BIGINT AS numbers, round(sum(CASE WHEN event_id % 3 = 0 THEN value END), 4) AS total FROM events WHERE event_id % 3 <> 2 GROUP BY 1""")
def q_report_key_values(spark, d):
    """Lines of reports, one an event: key and number, key and text with another colon, no key."""
    k = F.col("event_id") % 3
    line = F.when(k == 0, F.concat(F.lit(" "), "event_type", F.lit(":  "), F.col("value").cast("string"))).when(k == 1, F.concat("event_type", F.lit(": a: b"))).otherwise(F.col("event_type"))
    found = report.key_values(t(spark, d, "events").select(line.alias("value")))
    return found.groupBy("key").agg(F.count("*").alias("lines"), F.count("number").alias("numbers"), F.round(F.sum("number"), 4).alias("total"))


@query("""SELECT event_type AS task, CAST(ts AS DATE)::VARCHAR AS revision, count(*)::BIGINT AS total, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS correct FROM events GROUP BY 1, 2""")
def q_stream_counters(spark, d):
    from ..functions.folders import new_folder
    from ..streaming.incremental import parquet_stream, run_available, totals

    base, source = new_folder(spark, "stream"), parquet_stream(spark, f"{d}/events.parquet")
    keys = [F.col("event_type").alias("task"), F.to_date("ts").cast("string").alias("revision")]
    run_available(source, lambda rows: rows.groupBy(*keys).agg(F.count("*").alias("total"), F.sum((F.col("value") > 50).cast("long")).alias("correct")), f"{base}/out", f"{base}/state")
    return totals(spark, f"{base}/out", ["task", "revision"])


@query("""WITH l AS (SELECT o_custkey AS run, (date_diff('day', DATE '1992-01-01', o_orderdate::DATE) // 120)::INTEGER AS epoch, arg_max(round(o_totalprice, 2), o_orderkey) AS metric FROM orders GROUP BY 1, 2),
w AS (SELECT *, max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n FROM l),
i AS (SELECT *, n - max(CASE WHEN coalesce(metric > top + 0.001, true) THEN n END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS waited FROM w)
SELECT run::VARCHAR AS run, count(*)::INTEGER AS epochs, round(max(metric), 2) AS best, arg_max(epoch, metric) AS best_epoch, min(CASE WHEN waited >= 3 THEN epoch END)::INTEGER AS stop FROM i GROUP BY 1""")
def q_stream_progress(spark, d):
    """Orders as the logs of a run for each customer, four months an epoch, later orders correcting earlier ones: best-so-far and early stopping by keyed state."""
    from ..functions.folders import new_folder
    from ..streaming import progress_stream
    from ..streaming.incremental import parquet_stream

    base = new_folder(spark, "progress")
    epoch = F.expr("cast(datediff(to_date(o_orderdate), date'1992-01-01') div 120 as int)")
    updates = progress_stream.followed(parquet_stream(spark, f"{d}/orders.parquet"), F.col("o_custkey"), epoch, F.round("o_totalprice", 2), F.col("o_orderkey"))
    progress_stream.run_available(updates, f"{base}/out", f"{base}/state")
    return progress_stream.latest(spark, f"{base}/out").select("run", "epochs", F.round("best", 2).alias("best"), "best_epoch", "stop")


@query("""WITH c AS (SELECT source, lang, avg(n_chars) AS v FROM documents WHERE NOT (source = 'src3' AND lang = 'de') AND source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2), t AS (SELECT count(DISTINCT lang) AS n FROM c), m AS (SELECT source, sum(v) / any_value(n) AS macro, count(*) AS present FROM c, t GROUP BY 1)
SELECT source, round(macro, 6) AS macro, present::BIGINT AS present, (rank() OVER (ORDER BY round(macro, 12) DESC))::INTEGER AS place FROM m""")
def q_leaderboard_macro(spark, d):
    """Sources as models, languages as tasks, one of which one model lacks."""
    rows = t(spark, d, "documents").filter("source is not null and lang is not null and not (source = 'src3' and lang = 'de')")
    return relate.leaderboard(rows.groupBy("source", "lang").agg(F.avg("n_chars").alias("v")), "source", "lang", "v").withColumn("macro", r6("macro"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS step FROM lineitem GROUP BY ALL), p AS (SELECT *, (step - 500) / 60000.0::DOUBLE AS done FROM s)
SELECT l_orderkey, l_linenumber, round(CASE WHEN step < 500 THEN 0.7::DOUBLE * step / 500 ELSE 0.7::DOUBLE * greatest(0.1::DOUBLE, 0.1::DOUBLE + 0.9::DOUBLE * (1 + cos(pi() * done)) / 2) END, 6) AS rate FROM p""")
def q_learning_rate(spark, d):
    """A cosine schedule with warm-up, a step for each line of an order."""
    steps = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return steps.select("l_orderkey", "l_linenumber", F.round(learning_rate(F.col("l_orderkey") * 10 + F.col("l_linenumber"), 60_500, 500, 0.7), 6).alias("rate"))


@query(f"""WITH k AS (SELECT conv_id, turn, role, unnest(list_zip({TOK('text')}, range(0, len({TOK('text')})))) AS x FROM conversations) SELECT conv_id, turn, role, round(sum(CASE WHEN x[2] >= 2 THEN -{H('x[1]')} ELSE 0 END), 6) AS logprob, count(*)::BIGINT AS n_tokens FROM k GROUP BY 1, 2, 3""")
def q_sequence_scores(spark, d):
    """Token scores summed up over what comes behind a prefix of two tokens."""
    each = t(spark, d, "conversations").select("conv_id", "turn", "role", F.posexplode(tokens(F.col("text"))).alias("pos", "token")).withColumn("logprob", -hash_score(F.col("token")))
    return score.sequence_scores(each, ["conv_id", "turn", "role"], inside=F.col("pos") >= 2).withColumn("logprob", r6("logprob"))


# ---- scorers, training logs, paths -----------------------------------------------------------------


@query(f"""SELECT p_partkey, CASE WHEN {H("p_partkey || '-0'")} <= {H("p_partkey || '-1'")} THEN 0 ELSE 1 END::INTEGER AS chosen FROM part""")
def q_scorer_protocol(spark, d):
    """Decode, score by a pluggable scorer, rank: the whole way of an item."""
    rows = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("question"), F.col("p_brand").alias("target_ans"), F.array("p_type").alias("distractors"))
    scored = score.surrogate("p_partkey", "cand_idx")(score.exploded(decode.decode("distractors", rows, carry=["p_partkey"]), ["p_partkey"]))
    return rank.choose(scored, ["p_partkey"]).select("p_partkey", F.col("chosen").cast("int").alias("chosen"))


@query("""SELECT user_id, round(-sum(ln((value + 1) / 1000)), 6) AS surprisal FROM events WHERE event_type = 'click' GROUP BY 1""")
def q_subtoken_product(spark, d):
    rows = t(spark, d, "events").filter("event_type = 'click'").withColumn("p", (F.col("value") + 1) / 1000)
    return score.word_surprisal(rows, ["user_id"], "p").withColumn("surprisal", r6("surprisal"))


LOGS = "g AS (SELECT event_type AS run, day(ts) AS epoch, round(avg(value), 6) AS metric FROM events GROUP BY 1, 2)"


def _logs(spark, d) -> DataFrame:
    return t(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch")).agg(r6(F.avg("value")).alias("metric"))


@query(f"""WITH {LOGS} SELECT run, epoch::INTEGER AS epoch, metric, max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best, coalesce(metric > max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM g""")
def q_best_so_far(spark, d):
    return progress.best_so_far(_logs(spark, d), ["run"], "epoch", "metric")


@query(f"""WITH {LOGS}, i AS (SELECT *, coalesce(metric > max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.001, true) AS i, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n FROM g),
w AS (SELECT *, n - max(CASE WHEN i THEN n END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS w FROM i) SELECT run, min(CASE WHEN w >= 3 THEN epoch END)::INTEGER AS stop FROM w GROUP BY 1""")
def q_early_stop(spark, d):
    return progress.stopped_at(_logs(spark, d), ["run"], "epoch", "metric")


@query(r"""SELECT DISTINCT regexp_extract(url, '/([0-9]+)', 1)::BIGINT AS step FROM pages WHERE regexp_matches(url, '/[0-9]+/?$')""")
def q_step_folders(spark, d):
    from ..sources.datasets import steps

    return steps(t(spark, d, "pages").select("url"), "url").select("step").distinct()


@query(r"""SELECT avg(g)::DOUBLE AS first_larger, count(*)::BIGINT AS n FROM (SELECT CASE WHEN list_position(e, list_max(e)) - 1 < 32 THEN 1 ELSE 0 END AS g FROM (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))""")
def q_class_from_logits(spark, d):
    return t(spark, d, "embeddings").select((rank.choose_in_array(F.col("embedding")) < 32).cast("double").alias("g")).agg(F.avg("g").alias("first_larger"), F.count("*").alias("n"))


@query("""WITH g AS (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS temp), x AS (SELECT temp, event_type, sum(-value / temp) AS s FROM events, g GROUP BY 1, 2) SELECT temp, event_type, round(s, 4) AS total FROM x""")
def q_temperature_grid(spark, d):
    grid = score.at_temperatures(t(spark, d, "events").select("event_type", (-F.col("value")).alias("logprob")), [0.5, 1.0, 2.0])
    return grid.groupBy("temp", "event_type").agg(F.round(F.sum("logprob"), 4).alias("total"))


# ---- engine extras: relational smoke ------------------------------------------------------------


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def q_join_semi(spark, d):
    big = t(spark, d, "orders").filter("o_totalprice > 300000")
    return t(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def q_join_anti(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def q_cube(spark, d):
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r6(F.sum("l_quantity")).alias("quantity"))


@query("""SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS last_three FROM events""")
def q_window_frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return t(spark, d, "events").select("event_id", "user_id", r6(F.sum("value").over(w)).alias("last_three"))


@query("""WITH v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), j AS (SELECT p.event_id, v.event_id AS view_id, row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC, v.event_id DESC) AS r FROM p JOIN v ON p.user_id = v.user_id AND v.ts <= p.ts) SELECT event_id, view_id FROM j WHERE r = 1""")
def q_asof_events(spark, d):
    """As-of join without pairs: the last view seen before each purchase, in one ordered pass over a user's events."""
    e = t(spark, d, "events").filter("event_type in ('view', 'purchase')")
    order = [F.col("ts"), F.when(F.col("event_type") == "view", 0).otherwise(1), F.col("event_id")]
    w = Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = e.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return seen.filter("event_type = 'purchase' and view_id is not null").select("event_id", "view_id")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), c AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n FROM c GROUP BY 1, 2""")
def q_session_windows(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    e = t(spark, d, "events").withColumn("s", F.when(gap <= F.expr("INTERVAL 6 HOUR"), 0).otherwise(1))
    return e.withColumn("session", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).groupBy("user_id", "session").agg(F.count("*").alias("n"))


from . import evaluation  # noqa: E402, F401  (registers its queries)
