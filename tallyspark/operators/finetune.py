"""Fine-tuning tasks: column roles, templates, dataset configurations, label decoding and prediction files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text columns, paired columns and template of each classification task.
TASKS = {
    "boolq": (["question"], ["passage"], None),
    "cola": (["sentence"], None, None),
    "mnli": (["premise"], ["hypothesis"], None),
    "mrpc": (["sentence1"], ["sentence2"], None),
    "multirc": (["question", "answer"], ["paragraph"], "Question: {} Answer: {}"),
    "qnli": (["question"], ["sentence"], None),
    "qqp": (["question1"], ["question2"], None),
    "rte": (["sentence1"], ["sentence2"], None),
    "sst2": (["sentence"], None, None),
    "wsc": (["span2_text", "span1_text"], ["text"], 'Does "{}" refer to "{}" in this passage?'),
}
# Text columns of the multilingual tasks.
KEYS = {
    "xnli": ("premise", "hypothesis"), "sib200": ("sentence", None), "arc": ("sentence", None), "belebele": ("sentence", None), "bmlama": ("sentence", None),
    "include": ("sentence", None), "mmlu": ("sentence", None), "mnli": ("premise", "hypothesis"), "truthfulqa": ("sentence", None), "xcopa": ("sentence1", "sentence2"),
}


def filled(columns: list[str], template: str | None = None) -> Column:
    """The columns' texts put into the template's places, or joined by blanks; null if any is."""
    parts = [F.col(f"`{c}`").cast("string") for c in columns]
    if template is None:
        return F.concat(*[x for k, p in enumerate(parts) for x in ([F.lit(" ")] * bool(k) + [p])])
    texts = template.split("{}")
    if len(texts) != len(parts) + 1:
        raise ValueError(f"{template!r} has {len(texts) - 1} places for {len(parts)} columns")
    return F.concat(*[x for t, p in zip(texts, [*parts, F.lit("")]) for x in (F.lit(t), p)])


def classification_rows(rows: DataFrame, task: str, labelled: bool = True, carry: list[str] = ()) -> DataFrame:
    """(carry, text, pair, label) of a task's rows; without labels where they are to be predicted."""
    if task not in TASKS:
        raise NotImplementedError(f"{task!r} is no task; there are {sorted(TASKS)}")
    text, pair, template = TASKS[task]
    out = [filled(text, template).alias("text"), (filled(pair) if pair else F.lit(None).cast("string")).alias("pair")]
    return rows.select(*carry, *out, *([F.col("label").cast("int").alias("label")] if labelled else []))


def text_roles(columns: list[str]) -> tuple[list[str], str | None, str | None]:
    """Which columns hold the text and its pair, and the text's template, judged by their names."""
    names = [c for c in columns if c not in ("label", "idx")]
    has = set(names).issuperset
    for a, b in (("sentence1", "sentence2"), ("question1", "question2"), ("premise", "hypothesis"), ("question", "passage"), ("question", "sentence")):
        if has((a, b)):
            return [a], b, None
    for task in ("multirc", "wsc"):
        text, pair, template = TASKS[task]
        if has((*text, *pair)):
            return text, pair[0], template
    if has(("sentence", "linguistic_feature_type")):
        return ["sentence"], None, None
    if not names:
        raise ValueError("no text column")
    return names[:1], names[1] if len(names) > 1 else None, None


def codes(spark: SparkSession, one_to_three: dict[str, str], names: dict[str, str]) -> DataFrame:
    """(iso1, iso3, name) of languages, for joins; a table of fixed size."""
    return spark.createDataFrame([(a, b, names.get(a)) for a, b in sorted(one_to_three.items())], "iso1 string, iso3 string, name string")


def script_codes(entries: DataFrame, languages: DataFrame, prefix: str = "sib200_") -> DataFrame:
    """(iso1, config) of task names such as prefix + eng_Latn: names with another beginning, or not of two parts, are passed over."""
    rest = F.substring("entry", len(prefix) + 1, 1000)
    parts = F.split(rest, "_")
    two = entries.filter(F.col("entry").startswith(prefix) & (F.size(parts) == 2)).select(parts[0].alias("iso3"), rest.alias("config"))
    return two.join(F.broadcast(languages.select("iso1", "iso3")), "iso3").groupBy("iso1").agg(F.min("config").alias("config"))


#: Dataset families: which language code names the config, and the columns by their role.
FAMILIES = {
    "xnli": (("facebook/xnli", "HiTZ/xnli-eu"), "iso1", {"premise": "premise", "hypothesis": "hypothesis", "label": "label"}),
    "afrixnli": (("masakhane/afrixnli",), "iso3", {"premise": "premise", "hypothesis": "hypothesis", "label": "label"}),
    "sib200": (("Davlan/sib200",), "script", {"sentence": "text", "label": "category", "idx": "index_id"}),
    "afrimmlu": (("masakhane/afrimmlu",), "iso3", {"sentence": "question", "label": "answer"}),
    "belebele": (("facebook/belebele",), "script", {"sentence": "prompt", "label": "label"}),
    "include": (("CohereLabs/include-base-44",), "name", {"sentence": "prompt", "label": "label"}),
    "global_mmlu": (("CohereLabs/Global-MMLU",), "iso1", {"sentence": "question", "label": "answer"}),
    "copa": (("cambridgeltl/xcopa", "pkavumba/balanced-copa", "HiTZ/XCOPA-eu"), "iso1", {"sentence1": "premise", "sentence2": "premise", "label": "label"}),
}
#: Subtasks of the benchmark whose configs are named by subtask and language.
PREFIXED = {"arc": "ARCEasyDataset", "bmlama": "BMLAMADataset", "mmlu": "MMLUDataset", "truthfulqa": "TruthfulQADataset", "mnli": "MNLIDataset"}


def dataset_config(name: str, language: str, subtask: str | None = None, known: dict[str, dict[str, str]] | None = None) -> tuple[str, dict[str, str]]:
    """The config's name and the columns by role; known: by kind of code (iso3, name, script), the code of each language."""
    if name == "aialt/MuBench":
        if subtask not in PREFIXED:
            raise ValueError(f"{subtask!r} is no subtask; there are {sorted(PREFIXED)}")
        roles = FAMILIES["xnli"][2] if subtask == "mnli" else {"sentence": "prompt", "label": "label"}
        return f"{PREFIXED[subtask]}_en_template_{language}", dict(roles)
    for names, kind, roles in FAMILIES.values():
        if name in names:
            if kind == "iso1":
                return language, dict(roles)
            if language not in (known or {}).get(kind, {}):
                raise ValueError(f"{language!r} has no code of kind {kind}")
            return known[kind][language], dict(roles)
    raise ValueError(f"{name!r} is not supported")


def with_roles(rows: DataFrame, roles: dict[str, str]) -> DataFrame:
    """The columns under the names of their roles; idx is a number from 0 where the dataset has none."""
    return rows.select(*[F.col(f"`{c}`").alias(r) for r, c in roles.items()])


def local_dataset(spark: SparkSession, train: str, validation: str, test: str | None = None, schema: str | None = None) -> DataFrame:
    """All rows of local files with a `split`; files are .csv or .json, all of one kind; without a test file the validation file is it."""
    kinds = {p.rsplit(".", 1)[-1] for p in (train, validation, test) if p}
    if len(kinds) > 1 or not kinds <= {"csv", "json"}:
        raise ValueError(f"files come as .csv or as .json, all alike, not {sorted(kinds)}")
    read = spark.read.schema(schema) if schema else spark.read
    load = (lambda p: read.option("header", True).csv(p)) if kinds == {"csv"} else (lambda p: read.json(p))
    parts = [load(p).withColumn("split", F.lit(s)) for s, p in (("train", train), ("validation", validation), ("test", test or validation))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def prediction_lines(rows: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(index, prediction) as text: the label of a class, or a number with three digits; rows: (index, prediction)."""
    text = F.get(F.array(*map(F.lit, labels)), F.col("prediction").cast("int")) if labels is not None else F.format_string("%3.3f", F.col("prediction").cast("double"))
    return rows.select("index", text.alias("prediction"))


def result_lines(metrics: dict[str, float]) -> list[str]:
    """The lines of a results file: a `metric: value` each."""
    return [f"{k}: {v}" for k, v in metrics.items()]


def flat_predictions(rows: DataFrame, task: str) -> DataFrame:
    """(uid, seq, pred) of classes by index, as prediction documents want them."""
    return rows.select(F.lit(task).alias("uid"), F.col("index").cast("long").alias("seq"), F.col("prediction").cast("string").alias("pred"))
