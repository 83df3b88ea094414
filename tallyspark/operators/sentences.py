"""Sentences by abbreviations that a corpus itself tells: Kiss and Strunk's collocation test, then splitting.

A full stop belongs to an abbreviation if the word rarely comes without it. The counts of each word with and without a stop give a
likelihood ratio: that a stop follows by chance, as often as it follows any word, against that it nearly always does. It is weighed by
the word's length, its inner stops, and how often it comes without. All of it is two aggregations over words; a text is then
split with the abbreviations that it holds itself, so no list is shipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tokens

LEAST = 0.3  # the score from which a word is an abbreviation
ALWAYS = 0.99  # how often a stop follows an abbreviation
CLOSERS = r"[\"'’”»)\]]*"
BARE = r"^[\"'‘“«(\[]*(.*?)[.,;:!?\"'’”»)\]]*$"  # a token without marks around it
MARK = "\x1e"


def stopped(token: Column) -> Column:
    """The word before a token's last full stop, in lower case, without opening marks; null where it ends otherwise."""
    word = F.regexp_extract(F.lower(token), r"^[\"'‘“«(\[]*(.*?)\." + CLOSERS + "$", 1)
    return F.when(word.rlike(r"^[\p{L}.]*\p{L}$"), word)


def word_counts(rows: DataFrame, text: Column) -> DataFrame:
    """(word, with_stop, without): how often each word of letters comes with a full stop and without."""
    each = rows.select(F.explode(tokens(text)).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    bare = F.regexp_extract(F.lower("t"), r"^[\"'‘“«(\[]*(.*?)[,;:!?\"'’”»)\]]*$", 1)
    kinds = each.select(stopped(F.col("t")).alias("s"), F.when(bare.rlike(r"^[\p{L}.]*\p{L}$"), bare).alias("b"), "n")
    words = kinds.select(F.coalesce("s", "b").alias("word"), F.when(F.col("s").isNotNull(), F.col("n")).otherwise(0).alias("w"), F.when(F.col("s").isNull(), F.col("n")).otherwise(0).alias("o")).filter("word is not null")
    return words.groupBy("word").agg(F.sum("w").alias("with_stop"), F.sum("o").alias("without"))


def scored(counts: DataFrame) -> DataFrame:
    """(word, with_stop, without, score) of the words that come with a stop."""
    total = counts.agg(F.sum(F.col("with_stop") + F.col("without")).cast("double").alias("n"), F.sum("with_stop").cast("double").alias("s"))  # one row
    a, c = F.col("with_stop").cast("double"), (F.col("with_stop") + F.col("without")).cast("double")
    chance = F.least(F.greatest(F.col("s") / F.col("n"), F.lit(1e-9)), F.lit(1 - 1e-9))
    ratio = -2 * (a * F.log(chance) + (c - a) * F.log(1 - chance) - a * F.log(F.lit(ALWAYS)) - (c - a) * F.log(F.lit(1 - ALWAYS)))
    letters = F.length(F.replace("word", F.lit("."), F.lit(""))).cast("double")
    stops = (F.length("word") - letters + 1).cast("double")
    score = ratio * F.exp(-letters) * stops * F.pow(letters, -(c - a))
    return counts.filter("with_stop > 0").join(F.broadcast(total), F.lit(True)).select("word", "with_stop", "without", score.alias("score"))


def abbreviations(rows: DataFrame, text: Column, least: float = LEAST) -> DataFrame:
    """(word, score) of the corpus's abbreviations, without their last stop."""
    return scored(word_counts(rows, text)).filter(F.col("score") >= least).select("word", "score")


def starters(rows: DataFrame, text: Column) -> DataFrame:
    """(word) that a corpus writes small more often than with a capital: where one has a capital, it begins a sentence."""
    bare = F.regexp_extract("t", BARE, 1)
    each = rows.select(F.explode(tokens(text)).alias("t")).groupBy("t").agg(F.count("*").alias("n")).select(bare.alias("t"), "n").filter(F.col("t").rlike(r"^\p{L}"))
    small = F.col("t").rlike(r"^\p{Ll}")
    counts = each.groupBy(F.lower("t").alias("word")).agg(F.sum(F.when(small, F.col("n")).otherwise(0)).alias("small"), F.sum(F.when(small, 0).otherwise(F.col("n"))).alias("capital"))
    return counts.filter("small > capital").select("word")


def split(rows: DataFrame, key: list[str], text: str, known: DataFrame, begin: DataFrame, out: str = "sentences") -> DataFrame:
    """`rows` with `out`: the sentences of each text, their white space as single blanks. key tells rows apart; known, begin: abbreviations and starters (word).

    Null texts stay null; texts without a word have no sentence. Each text meets only those words of both lists that it holds."""
    words = tokens(F.col(text))
    pairs = F.zip_with(words, F.slice(F.concat(words, F.array(F.lit(""))), 2, F.size(words)), lambda w, n: F.struct(w.alias("w"), n.alias("n")))
    closed = F.filter(pairs, lambda p: stopped(p["w"]).isNotNull())
    held = rows.select(*key, F.explode(F.array_distinct(F.flatten(F.transform(closed, lambda p: F.array(F.struct(F.lit(0).alias("kind"), stopped(p["w"]).alias("word")), F.struct(F.lit(1).alias("kind"), F.lower(F.regexp_extract(p["n"], BARE, 1)).alias("word"))))))).alias("h"))
    lists = known.select(F.lit(0).alias("kind"), "word").union(begin.select(F.lit(1).alias("kind"), "word")).distinct()
    mine = held.select(*[F.col(c).alias(f"__key_{c}") for c in key], "h.kind", "h.word").join(lists, ["kind", "word"], "left_semi")
    of = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("word")))
    mine = mine.groupBy(*[f"__key_{c}" for c in key]).agg(of(0).alias("__known"), of(1).alias("__begin"))
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    none = F.array().cast("array<string>")
    met = rows.join(mine, on, "left").withColumns({c: F.coalesce(c, none) for c in ("__known", "__begin")})
    marked = F.transform(pairs, lambda p: F.concat(p["w"], F.when(ends(p["w"], p["n"], F.col("__known"), F.col("__begin")), F.lit(MARK)).otherwise(F.lit(" "))))
    said = F.filter(F.transform(F.split(F.array_join(marked, ""), MARK), lambda s: F.trim(s)), lambda s: s != "")
    return met.withColumn(out, F.when(F.col(text).isNotNull(), said)).select(*rows.columns, out)


def ends(word: Column, following: Column, known: Column, begin: Column) -> Column:
    """Whether a sentence ends with this word.

    It does at a mark; but a single letter's stop is an initial's and ends nothing, a number's ends nothing before a small letter, and an abbreviation's
    nothing but before a starter with a capital, or at the text's end."""
    stop, bare = stopped(word), F.regexp_extract(following, BARE, 1)
    small = bare.rlike(r"^[\p{Ll}\p{N}]")
    initial = F.coalesce(stop.rlike(r"^\p{L}$"), F.lit(False))
    abbreviation = F.coalesce(F.array_contains(known, stop), F.lit(False)) & (small | ~F.array_contains(begin, F.lower(bare))) & (following != "")
    return word.rlike(r"[.!?…]" + CLOSERS + "$") & ~initial & ~abbreviation & ~(word.rlike(r"^\p{N}+\.$") & small)
