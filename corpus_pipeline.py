"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of documents, extra ones and such with the names of an operator's own columns too, unchanged. Each result is written
as Parquet in the shared folder and read again.

All stages alike: an empty table gives an empty one; null and empty texts are clean, hold no line, shingle or
item, and encode to no token; rows with a null id are judged by their text alone, and are nobody's copy or original; repeated rows meet the
same decision; very long texts are read whole. Ties: of equal or similar documents the one with the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import _shared as shared
from tallyspark.llm import bpe, decontamination, line_dedup, ngram_join, toxicity_grammar
from tallyspark.llm.queries import vocabulary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score one half or more; the model is fitted as for op2. Null and empty texts score the bias, below one half, and stay."""
    shared.bounded(spark)
    model = toxicity_grammar.train(docs, shared.table(spark, sf_dir, "labels"))
    return toxicity_grammar.drop_toxic(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated blocks from the later documents; n_chars follows the text. A document of which nothing is left goes;
    one that had no line before stays, and so does every row with a null id. Repeated rows are one document, and lose nothing to each other."""
    shared.bounded(spark)
    own = {c: shared.unused(f"own_{c}", docs) for c in ("n_lines", "n_deleted", "blocks") if c in docs.columns}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(own)).filter((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.drop("n_lines", "n_deleted", "blocks").withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (Jaccard similarity of 0.8 or more, or a chain of such links).
    Rows with a null id stay; of rows that share an id all or none stay."""
    shared.bounded(spark)
    return ngram_join.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, whole or edited. An empty benchmark, items without words or with a null id drop nothing."""
    shared.bounded(spark)
    return decontamination.drop_contaminated(docs, shared.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left, a row each; a null text is empty."""
    shared.bounded(spark)
    return bpe.digests(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL can't express the fitted grammar, the alignments and the merges: tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared.stored(docs)
    return docs
