"""Many task configs over one table in one pass.

Thousands of configs ask for the rows of one category each. Run one by one they would read their table thousands of times; here an
index from (column, value) to configs meets the rows in one equi-join, and each row goes to every config that asks for it. Configs with
the same templates share one compiled form, so a plan has as many expressions as there are different templates, not configs.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tasks

#: An index of at most so many entries goes to every executor (a few MB); a longer one is joined by a shuffle.
BROADCAST = 20_000
FORM = ("doc_to_text", "doc_to_choice", "doc_to_target", "target_delimiter")


def form_of(config: dict) -> str:
    return json.dumps([config.get(k) for k in FORM], sort_keys=True)


def entries(configs: list[dict], functions: dict[str, tasks.Filter] | None = None, forms: dict[str, int] | None = None) -> list[tuple]:
    """(column, value, rest, task, description, form): the configs by one of the values that they ask for, the others in `rest`.

    Of several columns that with the most different values over all configs is the key. Configs that take every row have an empty column and value."""
    asked = [tasks.category_filter(c, functions) for c in configs]
    values: dict[str, set] = {}
    for filter_ in asked:
        for column, value in filter_.items():
            values.setdefault(column, set()).add(str(value))
    out = []
    for config, filter_ in zip(configs, asked):
        key = min(filter_, key=lambda c: (-len(values[c]), c), default="")
        rest = {c: str(v) for c, v in filter_.items() if c != key}
        out.append((key, str(filter_.get(key, "")), rest, config["task"], str(config.get("description", "")), (forms or {}).get(form_of(config), 0)))
    return out


def routed(rows: DataFrame, configs: list[dict], functions: dict[str, tasks.Filter] | None = None, forms: dict[str, int] | None = None) -> DataFrame:
    """The rows with task, description and form, once for each config that takes them. One scan; a null is no value."""
    taken = sorted({"task", "description", "form"} & set(rows.columns))
    if taken:
        raise ValueError(f"the table has columns named {', '.join(taken)}")
    doubled = len(configs) - len({c["task"] for c in configs})
    if doubled:
        raise ValueError(f"{doubled} tasks have more than one config")
    asked = [tasks.category_filter(c, functions) for c in configs]
    columns = sorted({c for f in asked for c in f})
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"filters ask for {', '.join(missing)}, which the table lacks")
    made = entries(configs, functions, forms)
    found = rows.sparkSession.createDataFrame(made, "column string, value string, rest map<string,string>, task string, description string, form int")
    keys = sorted({e[0] for e in made})
    text = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit("")
    # each row becomes several, with a prompt each: a task that read a whole file of short rows would hold them all
    many = max(4 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(many, F.monotonically_increasing_id())
    each = rows.withColumn("__key", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in keys]))) if keys else rows.withColumn("__key", F.lit(None).cast("struct<column:string,value:string>"))
    met = each.join(F.broadcast(found) if len(configs) <= BROADCAST else found, (F.col("__key.column") == F.col("column")) & (F.col("__key.value") == F.col("value")))
    own = F.create_map(*[x for c in columns for x in (F.lit(c), text(c))]) if columns else F.create_map().cast("map<string,string>")
    fits = F.forall(F.map_entries("rest"), lambda e: F.coalesce(F.try_element_at(own, e["key"]) == e["value"], F.lit(False)))
    return met.filter(fits).select(*[F.col(f"`{c}`") for c in rows.columns], "task", "description", "form")


def prompted(rows: DataFrame, configs: list[dict], functions: dict[str, tasks.Filter] | None = None) -> DataFrame:
    """The rows of all configs with task, prompt, choices, target and continuations, as tasks.prompted gives them for one."""
    forms = {f: k for k, f in enumerate(dict.fromkeys(map(form_of, configs)))}
    like = {forms[form_of(c)]: c for c in configs}
    if not configs:
        raise ValueError("no configs")

    def by_form(make) -> Column:
        out = None
        for k, config in sorted(like.items()):
            value = make(config)
            out = F.when(F.col("form") == k, value) if out is None else out.when(F.col("form") == k, value)
        return out

    names = rows.columns
    choices = by_form(lambda c: tasks.choices_of(c, names))
    text = F.concat("description", by_form(lambda c: tasks.doc_to_text(c["doc_to_text"], names)))
    delimiter = by_form(lambda c: F.lit(str(c.get("target_delimiter", " "))))
    out = routed(rows, configs, functions, forms).withColumns({"choices": choices, "prompt": text, "__delimiter": delimiter})
    target = by_form(lambda c: tasks.target_of(c, rows.schema, F.col("choices")))
    return out.withColumns({"target": target, "continuations": F.transform("choices", lambda c: F.concat("__delimiter", c))}).drop("description", "form", "__delimiter")
