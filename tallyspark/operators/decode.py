"""Decoders: task rows to the canonical ranking datum.

The datum is (uid, label, candidates array<struct<sentence, prefix, completion>>, meta map<string, string>).
Each decoder is a projection, or an explode of a fixed number of rows; a registry finds it by task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def decoder(task: str):
    def add(f):
        REGISTRY[task] = f
        return f

    return add


def decode(task: str, rows: DataFrame, **how) -> DataFrame:
    if task not in REGISTRY:
        raise NotImplementedError(f"no decoder for {task!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[task](rows, **how)


def candidate(sentence: Column, prefix: Column | None, completion: Column) -> Column:
    return F.struct(sentence.alias("sentence"), (prefix if prefix is not None else F.lit(None).cast("string")).alias("prefix"), completion.alias("completion"))


def _datum(rows: DataFrame, uid: Column, candidates: Column, label: Column, meta: dict[str, Column], carry: list[str]) -> DataFrame:
    kept = F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]) if meta else F.lit(None).cast("map<string,string>")
    return rows.select(*carry, uid.cast("string").alias("uid"), label.cast("int").alias("label"), candidates.alias("candidates"), kept.alias("meta"))


@decoder("minimal_pairs")
def minimal_pairs(rows: DataFrame, stem: Column | None = None, carry: list[str] = ()) -> DataFrame:
    """A good and a bad sentence; rows without a field are of the supplement, named by their file."""
    stem = stem if stem is not None else F.lit("")
    has = F.col("field").isNotNull()
    pair = F.array(*[candidate(F.col(c), None, F.col(c)) for c in ("sentence_good", "sentence_bad")])
    field = F.when(F.col("field") == "syntax_semantics", F.lit("syntax/semantics")).otherwise(F.col("field"))
    extra = lambda c: F.when(has, c).otherwise(F.lit("supplement"))
    return _datum(rows, F.when(has, F.col("UID")).otherwise(stem), pair, F.lit(0), {"field": extra(field), "linguistics_term": extra(F.col("linguistics_term"))}, list(carry))


@decoder("world_knowledge")
def world_knowledge(rows: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Two rows of each: both targets, each with the contexts in the order that puts its own first."""
    side = lambda t, a, b: F.struct(F.col(t).alias("t"), F.col(a).alias("a"), F.col(b).alias("b"))
    two = rows.withColumn("__s", F.explode(F.array(side("Target1", "Context1", "Context2"), side("Target2", "Context2", "Context1"))))
    tail = F.concat(F.lit(" "), F.col("__s.t"))
    both = F.array(*[candidate(F.concat(F.col(f"__s.{c}"), tail), F.col(f"__s.{c}"), tail) for c in "ab"])
    return _datum(two, F.col("Domain"), both, F.lit(0), {c: F.col(c) for c in ("ContextType", "ContextDiff", "TargetDiff")}, list(carry))


@decoder("entity_tracking")
def entity_tracking(rows: DataFrame, stem: Column | None = None, carry: list[str] = ()) -> DataFrame:
    options = F.transform("options", lambda o: candidate(F.concat(F.col("input_prefix"), o), F.col("input_prefix"), o))
    uid = F.concat_ws("_", stem if stem is not None else F.lit("regular"), F.col("numops").cast("string"), F.lit("ops"))
    return _datum(rows, uid, options, F.lit(0), {"numops": F.col("numops")}, list(carry))


@decoder("concept_pairs")
def concept_pairs(rows: DataFrame, stem: Column | None = None, carry: list[str] = ()) -> DataFrame:
    tail = F.concat(F.lit(" "), F.col("property_phrase"))
    both = F.array(*[candidate(F.concat(F.col(c), tail), F.col(c), tail) for c in ("prefix_acceptable", "prefix_unacceptable")])
    name = stem if stem is not None else F.lit("base")
    uid = F.when(name.endswith("base"), "base").when(name.endswith("wugs"), "wugs").when(name.endswith("before"), "wugs_dist_before").otherwise("wugs_dist_in_between")
    return _datum(rows, uid, both, F.lit(0), {}, list(carry))


@decoder("distractors")
def distractors(rows: DataFrame, carry: list[str] = ()) -> DataFrame:
    """The target first, then any number of distractors."""
    space = F.lit(" ")
    every = F.transform(F.concat(F.array("target_ans"), F.coalesce("distractors", F.array().cast("array<string>"))), lambda a: candidate(F.concat(F.col("question"), space, a), F.col("question"), F.concat(space, a)))
    return _datum(rows, F.lit("vqa"), every, F.lit(0), {}, list(carry))


@decoder("captions")
def captions(rows: DataFrame, carry: list[str] = ()) -> DataFrame:
    both = F.array(*[candidate(F.col(c), None, F.col(c)) for c in ("caption_0", "caption_1")])
    sub = F.concat_ws(" ", "tag", "secondary_tag")
    return _datum(rows, F.lit("captions"), both, F.lit(0), {"type": F.col("collapsed_tag"), "feature": F.col("tag"), "sub_feature": sub}, list(carry))


def swapped(rows: DataFrame, pairs: list[tuple[str, str]], flag: str = "swapped") -> DataFrame:
    """Every row, and the row with the columns of each pair exchanged."""
    inside = {c for p in pairs for c in p}
    way = lambda s: F.struct(F.lit(s).alias("__f"), *[F.col(b if s else a).alias(a) for a, b in pairs], *[F.col(a if s else b).alias(b) for a, b in pairs])
    two = rows.withColumn("__p", F.explode(F.array(way(False), way(True))))
    return two.select(*[c for c in rows.columns if c not in inside], *[F.col(f"__p.{c}").alias(c) for p in pairs for c in p], F.col("__p.__f").alias(flag))


def multiple_choice(question: Column, options: list[Column], letters: str = "ABCD", mark: str = ". ") -> Column:
    """A prompt: the question, then a line for each option with its letter."""
    lines = [F.concat(F.lit(letter + mark), o) for letter, o in zip(letters, options)]
    return F.concat_ws("\n", question, *lines, F.lit("Answer:"))


def label_at(labels: Column, index: Column) -> Column:
    """The label at a 0-based index; null beyond the array."""
    return F.get(labels, index)


def template(text: str, **columns: Column) -> Column:
    """A text with {name} places filled; null if any value is."""
    out, rest = [], text
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before)] * bool(before) + [columns[name].cast("string")]
    return F.concat(*out, *([F.lit(rest)] if rest else []))


def cause_effect(premise: Column, choice: Column, question: Column) -> Column:
    return F.when(question == "cause", F.concat_ws(" ", choice, premise)).when(question == "effect", F.concat_ws(" ", premise, choice)).otherwise(F.lit(""))


def other_columns(rows: DataFrame, used: list[str]) -> Column:
    """Every other column of a row as a map of texts, nulls left out: the metadata of a datum."""
    rest = [c for c in rows.columns if c not in used]
    if not rest:
        return F.create_map().cast("map<string,string>")
    pairs = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def label_ids(rows: DataFrame, label: str, out: str = "label_id") -> DataFrame:
    """Numbers of the sorted distinct labels; -1 stays. The distinct labels are few by contract and checked before they are broadcast."""
    names = rows.select(F.col(label).cast("string").alias("__l")).distinct().filter("__l is not null and __l <> '-1'")
    found = sorted(r[0] for r in names.limit(10_001).collect())
    if len(found) > 10_000:
        raise ValueError(f"{label} has more than 10000 values; it is no class label")
    ids = F.create_map(*[x for k, v in enumerate(found) for x in (F.lit(v), F.lit(k))]) if found else F.create_map().cast("map<string,int>")
    return rows.withColumn(out, F.when(F.col(label).cast("string") == "-1", F.lit(-1)).otherwise(F.try_element_at(ids, F.col(label).cast("string"))))
