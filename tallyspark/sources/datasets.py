"""Datasets by name: local copies of hub tables as <root>/<name>/<config>/<split>.parquet or .jsonl."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dataset(spark: SparkSession, root: str, name: str, config: str = "default", split: str | None = None, schema: str | None = None) -> DataFrame:
    """All splits with a `split` column, or one; parquet unless a schema says JSON lines."""
    kind = "parquet" if schema is None else "jsonl"
    places = f"{root}/{name}/{config}/{split or '*'}.{kind}"
    rows = spark.read.parquet(places) if schema is None else spark.read.schema(schema).json(places)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)\.{kind}(?:/[^/]*)?$", 1).alias("split"))


def dataset_or_none(spark: SparkSession, root: str, name: str, configs: list[str], needed: list[str] = (), schema: str | None = None) -> DataFrame | None:
    """The first of these configs that is there, such as a language and then the default; None where none is, so that a language can be left out.

    A table that lacks a needed column is an error, with the columns that it has."""
    for config in configs:
        try:
            rows = dataset(spark, root, name, config, schema=schema)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            continue
        missing = [c for c in needed if c not in rows.columns]
        if missing:
            raise ValueError(f"{name}/{config} has no column {', '.join(missing)}; there are {rows.columns}")
        return rows
    return None


def steps(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, step) of folders that are named by a number, the last ones first; others are passed over."""
    step = F.element_at(F.split(F.regexp_replace(F.col(path), "/+$", ""), "/"), -1).try_cast("long")
    return paths.select(path, step.alias("step")).filter("step is not null").orderBy(F.desc("step"))


def yaml_loader(root: str):
    """A loader of task configs for tasks.resolve, by their paths below `root`, where PyYAML is installed. Function tags stay as text;
    `tasks.category_filter` resolves them by a table that the caller gives, and takes none that it doesn't know."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML configs needs PyYAML") from e
    from pathlib import Path

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_multi_constructor("!", lambda loader, suffix, node: f"!{suffix} {node.value}")
    known: dict[str, dict] = {}

    def load(name: str) -> dict:
        if name not in known:
            path = Path(root, name)
            if not path.is_file():
                raise FileNotFoundError(str(path))
            known[name] = yaml.load(path.read_text(encoding="utf-8"), Loader) or {}
        return known[name]

    return load


def found_results(paths: DataFrame, kind: str, path: str = "path") -> DataFrame:
    """The paths that follow a pattern of result files, with the keys that their folders tell."""
    pattern, names = PATTERNS[kind]
    rows = paths.filter(F.col(path).rlike(pattern))
    return rows.select(path, *[F.regexp_extract(path, pattern, k + 1).alias(n) for k, n in enumerate(names)])


#: Patterns of result files (fixed values), and the names of their parts.
PATTERNS = {
    "best_temperature": (r"([^/]+)/main/([^/]+)/causal/([^/]+)/([^/]+)/best_temperature_report\.txt$", ["model", "kind", "task", "subtask"]),
    "finetune": (r"([^/]+)/main/finetune/([^/]+)/results\.txt$", ["model", "task"]),
    "evaluation": (r"([^/]+)/([^/]+)/eval_results\.json$", ["model", "task"]),
    "all_results": (r"([^/]+)/([^/]+)/([^/]+)/all_results\.json$", ["model", "language", "task"]),
    "harness": (r"([^/]+)/results[^/]*\.json$", ["folder"]),
    "harness_of_model": (r"(?:^|/)(?:[^/]*__)?([^/]+?)/results_[^/]*\.json$", ["model"]),
}
