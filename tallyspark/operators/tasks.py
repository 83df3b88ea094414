"""The declarative task layer: config files with inheritance, group trees, size-weighted roll-ups.

Configs are small and resolved on the driver; what they say about rows runs as DataFrame expressions.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import templates
from .rank import rollup_weighted


def resolve(name: str, load: Callable[[str], dict], seen: tuple[str, ...] = ()) -> dict:
    """The config with what it includes underneath: the includer's keys win. An include is relative to the folder of the config that has it."""
    name = posixpath.normpath(name)
    if name in seen:
        raise ValueError(" includes ".join([*seen, name]))
    config = dict(load(name))
    parent = config.pop("include", None)
    return resolve(posixpath.join(posixpath.dirname(name), parent), load, (*seen, name)) | config if parent else config


def ancestors(configs: list[dict]) -> list[tuple[str, str, int]]:
    """(leaf, group, depth) of every leaf below every group; a group lists tasks, groups or tags."""
    tags: dict[str, list[str]] = {}
    children: dict[str, list[str]] = {}
    leaves = set()
    for c in configs:
        if "group" in c:
            children[c["group"]] = [t if isinstance(t, str) else t.get("task", t.get("group")) for t in c.get("task", [])]
        else:
            leaves.add(c["task"])
            for tag in [c["tag"]] if isinstance(c.get("tag"), str) else c.get("tag", []):
                tags.setdefault(tag, []).append(c["task"])
    out: set[tuple[str, str, int]] = set()
    for group in children:
        stack, path = [(group, 0)], set()
        while stack:
            name, depth = stack.pop()
            if (name, depth) in path:
                continue
            path.add((name, depth))
            if depth > len(children) + 2:
                raise ValueError(f"{group} contains itself")
            if name in leaves:
                out.add((name, group, depth))
            stack += [(child, depth + 1) for child in children.get(name, tags.get(name, []))]
    return sorted(out)


def weights(configs: list[dict]) -> dict[str, bool]:
    """Whether each group's accuracy is weighted by size."""
    return {c["group"]: any(m.get("weight_by_size", True) for m in c.get("aggregate_metric_list", [])) for c in configs if "group" in c}


def rollup(leaves: DataFrame, configs: list[dict], metric: str = "accuracy", size: str = "size") -> DataFrame:
    """(task_group, value, size): each group's mean of its leaves, weighted by size where its config says so."""
    spark = leaves.sparkSession
    both = rollup_weighted(leaves, closure(spark, configs).select("leaf", "task_group"), metric, size)
    how = spark.createDataFrame(sorted(weights(configs).items()), "task_group string, by_size boolean")
    return both.join(how, "task_group").select("task_group", F.when(F.col("by_size"), F.col("weighted")).otherwise(F.col("unweighted")).alias("value"), "size")


def rollup_generated(leaves: DataFrame, language: Column, label: str, by_size: bool = False, metric: str = "accuracy", size: str = "size") -> DataFrame:
    """(task_group, value, size) of the groups that `generated` makes of these leaves: one a language, and one over all; the leaves say which there are, so no name leaves the tables."""
    name = F.explode(F.array(F.concat_ws("_", F.lit(label), language), F.lit(label))).alias("task_group")
    rows = leaves.filter(language.isNotNull()).select(name, metric, size).groupBy("task_group")
    value = F.sum(F.col(metric) * F.col(size)) / F.sum(size) if by_size else F.avg(metric)
    return rows.agg(value.alias("value"), F.sum(size).cast("long").alias("size"))


def choices_of(config: dict, columns: list[str]) -> Column:
    """The choices of a row: a fixed list of templates, the name of an array column, or one template expression that gives a list."""
    said = config.get("doc_to_choice")
    if said is None:
        raise ValueError(f"{config.get('task')} has no choices")
    if isinstance(said, str):
        if said in columns:
            return F.col(said)
        inner = templates.only_expression(said)
        if inner is None:
            raise ValueError(f"{said!r} of {config.get('task')} is neither a column nor a list expression")
        return templates.expression(inner, columns).cast("array<string>")
    return F.array(*[doc_to_text(str(x), columns) for x in said])


#: A document filter: the values that columns must have.
Filter = dict[str, str]


def category_functions(column: str, values: list[str], module: str = "utils") -> dict[str, Filter]:
    """The filters that a family of configs names, one for each category: the name is the category in small letters, with an underscore for a blank and for ` & `."""
    slug = lambda v: v.lower().replace(" & ", "_").replace(" ", "_")
    return {f"{module}.process_{slug(v)}": {column: v} for v in values}


def category_filter(config: dict, functions: dict[str, Filter] | None = None) -> Filter:
    """The values that a config's `process_docs` asks for, {} where it has none. It is {column: value}, or a function tag that `functions` knows; any other is an error."""
    said = config.get("process_docs")
    if said is None:
        return {}
    if isinstance(said, dict):
        return said
    name = re.sub(r"^!function\s+", "", str(said)).strip("'\" ")
    if name not in (functions or {}):
        raise ValueError(f"the filter {said!r} of {config.get('task')} isn't known")
    return functions[name]


def kept(condition: Filter) -> Column:
    """Whether a row has these values; null is no value."""
    out = F.lit(True)
    for column, value in sorted(condition.items()):
        out = out & F.coalesce(F.col(column).cast("string") == F.lit(str(value)), F.lit(False))
    return out


def split_of(config: dict, use: str) -> str | None:
    """The split for testing, few-shot examples or training; testing falls back on validation, examples on training, then on validation."""
    order = {"test": ("test_split", "validation_split"), "fewshot": ("fewshot_split", "training_split", "validation_split"), "train": ("training_split",), "validation": ("validation_split",)}
    return next((config[k] for k in order[use] if config.get(k)), None)


def target_of(config: dict, schema, choices: Column) -> Column:
    """The place of the right choice: a number, a column of numbers, or a text that is looked up among the choices."""
    said, columns = config.get("doc_to_target"), schema.names
    if isinstance(said, int):
        return F.lit(said)
    if said in columns and schema[said].dataType.typeName() != "string":
        return F.col(said).cast("int")
    return target_index(choices, doc_to_text(str(said), columns)).cast("int")


def prompted(rows: DataFrame, config: dict, examples: str = "", functions: dict[str, Filter] | None = None) -> DataFrame:
    """The rows with `prompt` (description, examples and text) and `choices`, `target` (its place among the choices) and `continuations`: what follows the prompt, choices behind the target delimiter."""
    rows = rows.filter(kept(category_filter(config, functions)))
    choices = choices_of(config, rows.columns)
    text = F.concat(F.lit(str(config.get("description", "")) + examples), doc_to_text(config["doc_to_text"], rows.columns))
    delimiter = F.lit(str(config.get("target_delimiter", " ")))
    return rows.withColumns({"prompt": text, "choices": choices, "target": target_of(config, rows.schema, choices), "continuations": F.transform(choices, lambda c: F.concat(delimiter, c))})


def generated(names: dict[str, list[str]], available: set[str], label: str, by_size: bool = False) -> list[dict]:
    """Group configs by rule: for each language its tasks of which a config is there, and one group over the languages that have any."""
    out = []
    for language, wanted in sorted(names.items()):
        found = [t for t in wanted if t in available]
        if found:
            out.append({"group": f"{label}_{language}", "task": found, "aggregate_metric_list": [{"metric": "acc", "weight_by_size": by_size}]})
    if out:
        out.append({"group": label, "task": [g["group"] for g in out], "aggregate_metric_list": [{"metric": "acc", "weight_by_size": by_size}]})
    return out


def group_text(config: dict) -> str:
    """A group config as YAML: plain keys, lists of names, lists of flat maps."""

    def value(v) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        return str(v) if isinstance(v, (int, float)) else json.dumps(v, ensure_ascii=False) if re.search(r"[^\w./-]", str(v)) or not str(v) else str(v)

    lines = []
    for key, said in config.items():
        if isinstance(said, list):
            lines.append(f"{key}:")
            for item in said:
                if isinstance(item, dict):
                    lines += [f"{'- ' if k == 0 else '  '}{a}: {value(b)}" for k, (a, b) in enumerate(item.items())]
                else:
                    lines.append(f"- {value(item)}")
        elif isinstance(said, dict):
            lines += [f"{key}:", *[f"  {a}: {value(b)}" for a, b in said.items()]]
        else:
            lines.append(f"{key}: {value(said)}")
    return "\n".join(lines) + "\n"


#: Metrics by name: a Column for the correctness of an item, and how items and then tasks are summed up.
METRICS: dict[str, Callable[[], Column]] = {
    "acc": lambda: (F.col("chosen") == F.col("target")).cast("double"),
    "exact_match": lambda: (F.trim("prediction") == F.trim("answer")).cast("double"),
    "mse": lambda: F.pow(F.col("prediction").cast("double") - F.col("answer").cast("double"), F.lit(2)),
}


def metric(name: str, make: Callable[[], Column] | None = None) -> Column:
    """A metric by its name; make: adds one."""
    if make is not None:
        METRICS[name] = make
    if name not in METRICS:
        raise NotImplementedError(f"no metric {name!r}; there are {sorted(METRICS)}")
    return METRICS[name]()


def measured(items: DataFrame, config: dict, by: list[str] = ()) -> DataFrame:
    """One mean for each metric of the config's list, and the number of items."""
    names = [m["metric"] for m in config.get("metric_list", [{"metric": "acc"}])]
    return items.groupBy(*by).agg(*[F.avg(metric(n)).alias(n) for n in names], F.count("*").alias("size"))


def closure(spark: SparkSession, configs: list[dict]) -> DataFrame:
    return spark.createDataFrame(ancestors(configs), "leaf string, task_group string, depth int")


def doc_to_text(pattern: str, columns: list[str]) -> Column:
    """A column's name, or a template."""
    return F.col(pattern) if pattern in columns else templates.text(pattern, columns)


def target_index(choices: Column, target: Column) -> Column:
    """The 0-based place of a label among the choices; null if it is none of them."""
    at = F.array_position(choices, target)
    return F.when(at > 0, at - 1)
