"""Raw multiple-choice and pair tables to one fine-tuning record: (idx, text columns, label string).

A shape says how the text columns and the label of a kind of table are built; every shape is a projection.
Missing text is empty, a label that can't be found is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip
from .decode import cause_effect, label_at
from .text import cleaned

# What is removed from texts, by task; dot matches line ends where the pattern says so.
CLEANING = {
    "truthfulqa": r"(?i)Question:\s*|Answer:\s*|Answer\s+with\s+A,\s*B,\s*C,\s*D,\s*\.\.\.",
    "mmlu": r"(?is)Question:\s*|Choice\s|Answer with\s*(?:,\s*)*.*?\nAnswer:",
    "arc": r"(?is)Question:\s*|Answer with\s*[A-D](?:,\s*[A-D])*.*?\nAnswer:",
    "bmlama": r"(?is)Question:\s*|Answer with\s*[A-D](?:,\s*[A-D])*.*?\nAnswer:",
    "default": r"(?i)Answer\s+with\s+A,\s*B,\s*C,\s*D,\s*\.\.\.",
}
LETTERS = "ABCD"

SHAPES: dict[str, Callable[[str], dict[str, Column]]] = {}


def shape(name: str):
    def add(f):
        SHAPES[name] = f
        return f

    return add


def _text(c: str | Column) -> Column:
    return strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _lines(*parts: Column) -> Column:
    return F.concat(*[x for p in parts for x in (p, F.lit("\n"))])


def _letter(index: Column) -> Column:
    return label_at(F.array(*map(F.lit, LETTERS)), index)


@shape("passage_choices")
def passage_choices(task: str) -> dict[str, Column]:
    """A passage, a question and four answers; the label counts from 1."""
    answers = [F.concat(F.lit(f"{letter}: "), _text(f"mc_answer{k + 1}")) for k, letter in enumerate(LETTERS)]
    return {"sentence": _lines(_text("flores_passage"), _text("question"), *answers), "label": _letter(F.col("correct_answer_num").try_cast("int") - 1)}


@shape("option_columns")
def option_columns(task: str) -> dict[str, Column]:
    """A question and four option columns; a number is a place from 0, letters stay."""
    options = [F.concat(F.lit(f"{letter}. "), _text(f"option_{letter.lower()}")) for letter in LETTERS]
    answer = F.col("answer").cast("string")
    number = answer.try_cast("int")
    return {"sentence": _lines(_text("question"), *options), "label": F.when(number.isNotNull(), _letter(number)).otherwise(answer)}


@shape("option_text")
def option_text(task: str) -> dict[str, Column]:
    """A question and its options as the text of a list, in either kind of quotes."""
    inner = F.regexp_replace("choices", r"""^\s*\[|\]\s*$""", "")
    each = F.regexp_extract_all(inner, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    plain = F.transform(each, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))
    options = [F.concat(F.lit(f"{letter}. "), F.coalesce(F.get(plain, F.lit(k)), F.lit(""))) for k, letter in enumerate(LETTERS)]
    whole = F.when(F.size(plain) >= 4, _lines(_text("question"), *options)).otherwise(F.lit(""))
    return {"sentence": whole, "label": F.col("answer").cast("string")}


@shape("cause_effect")
def two_choices(task: str) -> dict[str, Column]:
    side = lambda c: cause_effect(_text("premise"), _text(c), _text("question"))
    return {"sentence1": side("choice1"), "sentence2": side("choice2"), "label": F.col("label").cast("string")}


@shape("marked_pair")
def marked_pair(task: str) -> dict[str, Column]:
    """Premise and hypothesis between the marks of a prompt; the label is a place in choices."""
    prompt = _text("prompt")
    premise = F.regexp_extract(prompt, r"(?is)Premise:\s*(.*?)\nHypothesis:", 1)
    hypothesis = F.regexp_extract(prompt, r"(?is)Hypothesis:\s*(.*?)\s*Question:", 1)
    return {"premise": strip(premise), "hypothesis": strip(hypothesis), "label": label_at(F.col("choices"), F.col("label").try_cast("int"))}


@shape("prompt_choices")
def prompt_choices(task: str) -> dict[str, Column]:
    """A prompt without its fixed phrases; the label is a place in choices."""
    return {"sentence": cleaned(F.coalesce("prompt", F.lit("")), [CLEANING.get(task, CLEANING["default"])]), "label": label_at(F.col("choices"), F.col("label").try_cast("int"))}


def plain(columns: dict[str, str]) -> dict[str, Column]:
    """Columns as they are, without fixed phrases and outer white space."""
    return {out: F.col(c).cast("string") if out == "label" else cleaned(F.col(c), [CLEANING["default"]]) for out, c in columns.items()}


def unify(rows: DataFrame, kind: str, task: str = "default", idx: Column | None = None) -> DataFrame:
    """The records of a table; idx: a column that numbers them, or a hash of the row."""
    if kind not in SHAPES:
        raise NotImplementedError(f"no shape {kind!r}; there are {sorted(SHAPES)}")
    number = idx if idx is not None else F.xxhash64(*rows.columns)
    return rows.select(number.alias("idx"), *[c.alias(name) for name, c in SHAPES[kind](task).items()])
