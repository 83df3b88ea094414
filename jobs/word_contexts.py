"""Contexts of target words from a corpus that grows: the input of an age-of-acquisition evaluation.

A model's surprisal at a word is measured in the word's most frequent contexts. This job finds them: of every
sentence, each word after the first with up to `longest` words before it is counted if the word is a target; the `top` contexts of each
language and word are written, with the words' frequencies per million.

    python -m jobs.word_contexts --corpus DOCUMENTS --targets WORDS --out FOLDER --config jobs/word_contexts.json

Incremental: the corpus is a stream of Parquet files. A run takes the files that no run has taken yet, in micro-batches of `files_per_batch`, and stops. The
checkpoint in the output folder says which they are. Each batch writes its counts into a folder of its number, so
one that is repeated after a failure replaces what it wrote. Then the counts of all batches are summed and the two tables written anew. Of what they were written from
a mark is left, which is taken away while they are written: a run that finds nothing newer leaves the tables as they are, and one that failed between the steps is mended by the next.

Counts and checkpoint belong to one set of targets and one reading of the texts (`longest`, columns, tokens of a context): with
another, their folder is another one and the corpus is counted from its start. The number of contexts and other settings can change freely.

    OUT/counts/set=<mark>/batch=<n>     (language, word, ctx, n); a null word: all other words of the language
    OUT/checkpoint/set=<mark>           the stream's checkpoint
    OUT/published                       (mark, batch, top, contexts, words): the tables' set of targets, last batch, setting and rows
    OUT/contexts/language=<l>           (word, ctx, n, place), place from 1; ties by the context
    OUT/words/language=<l>              (word, n, frequency, log_per_million): of all words after the first of a sentence

Null and empty texts have no sentence. A null language is the partition that Spark names for it. Words and texts are lower-cased.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import checked, command, log
from tallyspark.functions.scalars import tokens
from tallyspark.operators import text
from tallyspark.streaming.incremental import parquet_stream, run_available

LOG = log("word_contexts")
COUNTS = "language string, word string, ctx string, n long"
A_TASK, FULL = 64, 8192  # rows of a task at least and at most, where they are dealt out
PUBLISHED = "mark string, batch long, top long, contexts long, words long"
CONTEXTS = "word string, ctx string, n long, place long, language string"
WORDS = "word string, n long, frequency double, log_per_million double, language string"
DEFAULTS = {
    "text": "text",
    "language": "lang",
    "targets": "text",  # a column of texts whose words are the targets
    "least_length": 2,  # of a target, in characters
    "longest": 4,  # words of a context
    "least_tokens": 1,  # of a context
    "top": 10,
    "files_per_batch": 1000,
    "broadcast_targets": 100_000,  # as many words at most go to all executors; more are met by a shuffle
}


def target_words(spark: SparkSession, path: str, settings: dict) -> DataFrame:
    """(word): the distinct lower-cased words of the table's texts that are long enough."""
    words = spark.read.parquet(path).select(F.explode(tokens(F.lower(F.col(settings["targets"])))).alias("word"))
    return words.filter(F.char_length("word") >= settings["least_length"]).distinct()


def mark_of(words: DataFrame, settings: dict) -> tuple[str, int]:
    """A name for this set of targets and this reading of the texts, and how many targets there are."""
    n, mixed = words.agg(F.count("*"), F.bit_xor(F.xxhash64("word"))).first()
    read = json.dumps({k: settings[k] for k in ("text", "language", "longest", "least_tokens")}, sort_keys=True)
    return f"{n}-{words.sparkSession.range(1).select(F.hex(F.xxhash64(F.lit(read), F.lit(mixed or 0)))).first()[0]}", n


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of a batch over more tasks than it has files, if they are many: what a task counts should fit its memory, and a file may be one task's."""
    context = rows.sparkSession.sparkContext
    many = max(4 * context.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // FULL)
    return rows.repartition(many, F.monotonically_increasing_id()) if n >= A_TASK * many else rows


def counted(rows: DataFrame, words: DataFrame, settings: dict, few: bool, n: int = 0) -> DataFrame:
    """(language, word, ctx, n) of a batch of n documents; what isn't a target's context is one row of a language."""
    texts = dealt(rows.select(F.col(settings["language"]).cast("string").alias("language"), F.col(settings["text"]).alias("text")), n)
    sentences = texts.select("language", F.explode(text.sentences(F.col("text"))).alias("sentence"))
    known, longest, least = words.withColumn("target", F.lit(True)), settings["longest"], settings["least_tokens"]
    near = longest is not None and longest <= text.WIDE
    each = text.windows(sentences, F.col("sentence"), longest, ["language"]) if near else text.contexts(sentences, F.col("sentence"), longest, ["language"])
    met = each.join(F.broadcast(known) if few else known, "word", "left")
    if near:  # only a target's words are put together
        ctx, enough = text.joined(longest), F.lit(True) if least <= 1 else F.col(f"before{least}").isNotNull() if least <= longest else F.lit(False)
    else:
        ctx, enough = F.col("ctx"), F.size(F.split("ctx", " ")) >= least
    keys = ["language", F.when(F.col("target"), F.col("word")).alias("word"), F.when(F.col("target") & enough, ctx).alias("ctx")]
    return met.groupBy(*keys).agg(F.count("*").alias("n"))


def frequent(each: DataFrame, top: int) -> DataFrame:
    """Without what comes less often than `top` contexts of its word and language; ties stay. Few words: what they need at least goes to all executors."""
    often = each.groupBy("language", "word", "n").agg(F.count("*").alias("contexts"))
    w = Window.partitionBy("language", "word").orderBy(F.desc("n"))
    full = often.withColumn("upto", F.sum("contexts").over(w)).filter(F.col("upto") >= top)
    least = full.groupBy("language", "word").agg(F.max("n").alias("least"))
    same = F.col("e.language").eqNullSafe(F.col("l.language")) & (F.col("e.word") == F.col("l.word"))
    met = each.alias("e").join(F.broadcast(least.alias("l")), same, "left")
    return met.filter(F.col("least").isNull() | (F.col("n") >= F.col("least"))).select("e.*")


def published(counts: DataFrame, top: int, one: bool = False, few: bool = False) -> tuple[DataFrame, DataFrame]:
    """(language, word, ctx, n, place) and (language, word, n, frequency, log_per_million) of all counts so far.

    Counts of one batch are sums as they are: no context is shuffled, and with few words only the frequent ones are sorted."""
    each = counts.filter("ctx is not null")
    sums = each.groupBy("language", "word", "ctx").agg(F.sum("n").alias("n")) if not one else frequent(each, top) if few else each
    w = Window.partitionBy("language", "word").orderBy(F.desc("n"), "ctx")  # a rank below a bound is cut before the shuffle, too
    contexts = sums.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= top)
    by_word = counts.groupBy("language", "word").agg(F.sum("n").alias("n"))
    totals = by_word.groupBy("language").agg(F.sum("n").alias("total"))
    both = by_word.filter("word is not null").alias("w").join(totals.alias("t"), F.col("w.language").eqNullSafe(F.col("t.language")))
    share = F.col("w.n").cast("double") / F.col("t.total")
    return contexts, both.select("w.language", "w.word", "w.n", share.alias("frequency"), F.log10(share * 1e6).alias("log_per_million"))


def table(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """What Parquet files are there; no rows where none was written yet, as of a corpus without a file."""
    try:
        return spark.read.schema(schema).options(**options).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def so_far(spark: SparkSession, counts: str) -> DataFrame:
    """The counts of all batches."""
    return table(spark, counts, COUNTS, recursiveFileLookup=True)


def output(spark: SparkSession, out: str) -> DataFrame:
    """Both tables as one: kind is `context` or `word`."""
    contexts = spark.read.schema(CONTEXTS).parquet(f"{out}/contexts")
    words = spark.read.schema(WORDS).parquet(f"{out}/words")
    return contexts.withColumn("kind", F.lit("context")).unionByName(words.withColumn("kind", F.lit("word")), allowMissingColumns=True)


def run(spark: SparkSession, corpus: str, targets: str, out: str, given: dict | None = None) -> dict:
    """Takes what is new in `corpus`, writes the tables under `out`; returns what it read and wrote."""
    settings, out = checked(given or {}, DEFAULTS), out.rstrip("/")
    words = target_words(spark, targets, settings)
    mark, n_targets = mark_of(words, settings)
    LOG.info("%d target words of %s, set %s", n_targets, targets, mark)
    counts, source = f"{out}/counts/set={mark}", parquet_stream(spark, corpus, settings["files_per_batch"])
    few = n_targets <= settings["broadcast_targets"]
    seen: list[int] = []

    def count(rows: DataFrame) -> DataFrame:
        seen.append(rows.count())  # Parquet's footers know
        return counted(rows, words, settings, few, seen[-1])

    run_available(source, count, counts, f"{out}/checkpoint/set={mark}")
    read = {"batches": len(seen), "rows": sum(seen)}
    LOG.info("read %d new rows of %s in %d batches", read["rows"], corpus, read["batches"])
    first, last = table(spark, counts, f"{COUNTS}, batch long").agg(F.min("batch"), F.max("batch")).first()  # of batches with rows
    state = {"mark": mark, "batch": last, "top": settings["top"]}
    stands = lambda: {name: table(spark, f"{out}/{name}", schema).count() for name, schema in (("contexts", CONTEXTS), ("words", WORDS))}
    wrote = {} if seen else stands()
    if seen or [r.asDict() for r in table(spark, f"{out}/published", PUBLISHED).collect()] != [state | wrote]:
        note = lambda rows: spark.range(rows).select(F.from_json(F.lit(json.dumps(state | wrote)), PUBLISHED).alias("s")).select("s.*").coalesce(1).write.mode("overwrite").parquet(f"{out}/published")
        note(0)
        for name, rows in zip(("contexts", "words"), published(so_far(spark, counts), settings["top"], first == last, few)):
            rows.repartition("language", F.pmod(F.xxhash64("word"), F.lit(16))).write.mode("overwrite").partitionBy("language").parquet(f"{out}/{name}")
        wrote = stands()
        note(1)
        for name, n in wrote.items():
            LOG.info("wrote %d rows to %s/%s", n, out, name)
    else:
        LOG.info("nothing newer than %s, which has %d contexts and %d words", out, wrote["contexts"], wrote["words"])
    return {"mark": mark, "targets": n_targets, **read, **wrote}


if __name__ == "__main__":
    command("word_contexts", "Contexts of target words from a corpus that grows.", {"corpus": "a folder of Parquet files of documents", "targets": "a Parquet table whose texts hold the target words", "out": "the output folder"}, run)
