"""Text operators: cleaning, n-gram contexts, vocabulary filters, token tables, block packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folders import stored
from ..functions.scalars import hash_score, strip, tokens
from .ordinals import running
from .stats import running_total


def cleaned(text: Column, patterns: list[str] = ()) -> Column:
    """Stripped, without what the patterns match (dot matches line ends, case doesn't matter), stripped again."""
    out = strip(text)
    for p in patterns:
        out = F.regexp_replace(out, "(?is)" + p, "")
    return strip(out)


def sentences(text: Column) -> Column:
    """Sentences by closing marks: an approximation of a rule-based segmenter."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


WIDE = 16  # words before a word that are made as columns at most


def windows(rows: DataFrame, text: Column, longest: int, carry: list[str] = ()) -> DataFrame:
    """(before<longest>, ..., before1, word), behind the columns in `carry`: every word but the first of each text beside the words before it, null where there is none.

    The columns are slices of one array, each a word further on: no function of a row's words, and a text is cut up once."""
    p = rows.select(*carry, F.concat(F.array_repeat(F.lit(None).cast("string"), longest - 1), tokens(F.lower(text))).alias("p"))
    n = F.greatest(F.size("p") - longest, F.lit(0))
    names = [*(f"before{k}" for k in range(longest, 0, -1)), "word"]
    return p.select(*carry, F.inline(F.arrays_zip(*[F.slice("p", F.lit(k + 1), n).alias(c) for k, c in enumerate(names)])))


def joined(longest: int) -> Column:
    """The words before one as a context."""
    return F.concat_ws(" ", *[f"before{k}" for k in range(longest, 0, -1)])


def contexts(rows: DataFrame, text: Column, longest: int | None = None, carry: list[str] = ()) -> DataFrame:
    """(ctx, word), behind the columns in `carry`: every word but the first of each text, with all words before it or the last `longest` of them.

    With `longest` the windows are made inside the array, so a row doesn't carry its text for each of its words and the work is linear in the text.
    Without it a text's contexts are as long as its square; they come one by one, for texts that are sentences."""
    if longest is not None and longest <= WIDE:
        return windows(rows, text, longest, carry).select(*carry, joined(longest).alias("ctx"), "word")
    t = rows.select(*carry, tokens(F.lower(text)).alias("t")).filter(F.size("t") > 1)
    if longest is None:
        at = t.select(*carry, "t", F.explode(F.sequence(F.lit(1), F.size("t") - 1)).alias("n"))
        return at.select(*carry, F.array_join(F.slice("t", F.lit(1), F.col("n")), " ").alias("ctx"), F.element_at("t", F.col("n") + 1).alias("word"))
    before = lambda i: F.slice("t", F.greatest(i - (longest - 1), F.lit(1)), F.least(i, F.lit(longest)))
    pairs = F.transform("t", lambda w, i: F.struct(F.array_join(before(i), " ").alias("ctx"), w.alias("word")))
    return t.select(*carry, F.explode(F.slice(pairs, F.lit(2), F.size("t") - 1)).alias("p")).select(*carry, "p.ctx", "p.word")


def context_counts(pairs: DataFrame) -> DataFrame:
    """(ctx, word, n, ctx_n): how often each word follows each context, and each context comes."""
    each = pairs.groupBy("ctx", "word").agg(F.count("*").alias("n"))
    return each.join(each.groupBy("ctx").agg(F.sum("n").alias("ctx_n")), "ctx")


def word_frequencies(pairs: DataFrame) -> DataFrame:
    """(word, n, frequency, log_per_million) of the words that follow contexts; the total is one number."""
    each = pairs.groupBy("word").agg(F.count("*").alias("n"))
    total = each.agg(F.sum("n")).first()[0] or 1  # one number
    share = F.col("n").cast("double") / F.lit(float(total))
    return each.select("word", "n", share.alias("frequency"), F.log10(share * 1e6).alias("log_per_million"))


def top_contexts(pairs: DataFrame, words: DataFrame, n: int, least_tokens: int = 1) -> DataFrame:
    """The n most frequent contexts of each target word; ties by the context. words: (word), few but not broadcast by force."""
    each = pairs.join(words.select("word").distinct(), "word", "left_semi").filter(F.size(F.split("ctx", " ")) >= least_tokens).groupBy("word", "ctx").agg(F.count("*").alias("n"))
    w = Window.partitionBy("word").orderBy(F.desc("n"), "ctx")
    return each.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= n)


def all_tokens_known(rows: DataFrame, key: str, text: Column, vocabulary: DataFrame) -> DataFrame:
    """Rows of which every lower-cased token is in the vocabulary (word); rows without tokens stay. No list is shipped: tokens meet words by a join."""
    each = rows.select(key, F.explode(F.array_distinct(tokens(F.lower(text)))).alias("word"))
    unknown = each.join(vocabulary.select("word").distinct(), "word", "left_anti").select(key).distinct()
    return rows.join(unknown, key, "left_anti")


def token_table(rows: DataFrame, key: list[str], text: Column) -> DataFrame:
    """(key, pos, token, char_start, char_end) of blank-separated tokens; offsets count characters from 0. key: of one row; its tokens' offsets are a running sum, linear in the text."""
    at = rows.select(*key, F.posexplode(F.split(text, " ")).alias("pos", "token")).withColumn("__n", F.char_length("token").cast("long") + 1)
    end = running(at, key, ["pos"], {"__end": ("__n", "sum")}, parts=1)
    return end.select(*key, F.col("pos").cast("long").alias("pos"), "token", (F.col("__end") - F.col("__n")).alias("char_start"), (F.col("__end") - 1).alias("char_end"))


def phrase_sum(spans: DataFrame, key: list[str], start: Column, value: str) -> DataFrame:
    """The sum of `value` over tokens that reach beyond a phrase's first character."""
    return spans.groupBy(*key).agg(F.sum(F.when(F.col("char_end") > start, F.col(value))).alias("total"), F.sum((F.col("char_end") > start).cast("long")).alias("n_tokens"))


def masked(rows: DataFrame, key: list[str], words: Column, mask: str = "[MASK]") -> DataFrame:
    """A row for each word with that word masked: (key, pos, target, masked)."""
    at = rows.select(*key, words.alias("__w")).select(*key, "__w", F.posexplode("__w").alias("pos", "target"))
    text = F.array_join(F.transform("__w", lambda w, i: F.when(i == F.col("pos"), F.lit(mask)).otherwise(w)), " ")
    return at.select(*key, F.col("pos").cast("long").alias("pos"), "target", text.alias("masked"))


def packed(rows: DataFrame, order: list, length: Column, block: int, by: list[str] = ()) -> DataFrame:
    """The block of `block` tokens in which each row begins and ends, in a running total within `by`.

    The total runs over the whole group in order, range by range of the first order column, which is a number."""
    total = running_total(rows.withColumn("__n", length.cast("long")), order, "__n", "end_token", by).drop("__n")
    return total.withColumn("end_token", F.col("end_token").cast("long")).withColumn("first_block", F.floor((F.col("end_token") - length) / block).cast("long")).withColumn("last_block", F.floor((F.col("end_token") - 1) / block).cast("long"))


def blocks(tokens_of: DataFrame, order: list[str], ids: str, size: int, batch: Column) -> DataFrame:
    """(batch, block, input_ids, attention_mask): the token streams of each batch cut into blocks of `size`; what is left at a batch's end goes.

    Tokens are numbered by running totals, so a batch isn't gathered: only the `size` tokens of a block meet."""
    rows = tokens_of.withColumn("batch", batch).withColumn("__n", F.size(ids).cast("long"))
    at = running_total(rows, order, "__n", "__end", ["batch"])
    each = at.select("batch", (F.col("__end") - F.col("__n")).alias("__begin"), F.posexplode(ids).alias("__i", "token"))
    place = F.col("__begin") + F.col("__i")
    full = each.select("batch", F.floor(place / size).cast("long").alias("block"), F.struct(place.alias("p"), "token").alias("x")).groupBy("batch", "block").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return full.filter(F.size("x") == size).select("batch", "block", F.transform("x", lambda x: x["token"]).alias("input_ids"), F.array_repeat(F.lit(1), size).alias("attention_mask"))


def padded(ids: Column, length: int, pad: int, left: bool = False) -> Column:
    """At most `length` tokens, filled up with `pad` at the right or the left."""
    cut = F.slice(ids, 1, length)
    fill = F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut))
    return F.concat(fill, cut) if left else F.concat(cut, fill)


def attention(ids: Column, length: int, left: bool = False) -> Column:
    """1 for tokens and 0 for what `padded` fills up."""
    n = F.least(F.size(ids), F.lit(length))
    ones, zeros = F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n)
    return F.concat(zeros, ones) if left else F.concat(ones, zeros)


def next_token_masked(rows: DataFrame, key: list[str], ids: Column, mask: int, prepend: int | None = None) -> DataFrame:
    """A row for each token after the first (for all, with a token prepended): (key, pos, target, input_ids, read_at).

    The target is masked and read off at the place before it, as models of masked next-token prediction do."""
    tokens_of = F.concat(F.array(F.lit(prepend)), ids) if prepend is not None else ids
    at = rows.select(*key, tokens_of.alias("__t")).select(*key, "__t", F.posexplode("__t").alias("pos", "target")).filter("pos > 0")
    return at.select(*key, F.col("pos").cast("long").alias("pos"), "target", F.transform("__t", lambda x, i: F.when(i == F.col("pos"), F.lit(mask)).otherwise(x)).alias("input_ids"), (F.col("pos") - 1).cast("long").alias("read_at"))


def encoder_decoder(rows: DataFrame, key: list[str], prefix: Column, completion: Column, sentinel: int, start: int) -> DataFrame:
    """(key, encoder_ids, decoder_ids, labels): the prefix with a sentinel for what follows; the decoder reads start and sentinel, then the completion shifted by one."""
    head = F.array(F.lit(start), F.lit(sentinel))
    n = F.size(completion)
    return rows.select(*key, F.concat(prefix, F.array(F.lit(sentinel))).alias("encoder_ids"), F.concat(head, F.slice(completion, F.lit(1), F.greatest(F.lit(0), n - 1))).alias("decoder_ids"), F.concat(F.array(F.lit(sentinel)), completion).alias("labels"))


def context_frequencies(pairs: DataFrame) -> DataFrame:
    """(ctx, word, n, frequency, log_per_million, ctx_n, ctx_frequency, ctx_log_per_million): of words within their context, and of contexts among all windows."""
    each = stored(pairs.groupBy("ctx", "word").agg(F.count("*").alias("n")))  # texts are cut up once
    both = each.join(each.groupBy("ctx").agg(F.sum("n").alias("ctx_n")), "ctx")
    total = float(each.agg(F.sum("n")).first()[0] or 1)  # one number
    inside, among = F.col("n").cast("double") / F.col("ctx_n"), F.col("ctx_n").cast("double") / F.lit(total)
    return both.select("ctx", "word", "n", inside.alias("frequency"), F.log10(inside * 1e6).alias("log_per_million"), "ctx_n", among.alias("ctx_frequency"), F.log10(among * 1e6).alias("ctx_log_per_million"))


def random_contexts(pairs: DataFrame, words: DataFrame, n: int, salt: str = "") -> DataFrame:
    """n contexts of each target word in the order of a hash: a sample that doesn't depend on the partitioning."""
    each = pairs.join(words.select("word").distinct(), "word", "left_semi").groupBy("word", "ctx").agg(F.count("*").alias("n"))
    w = Window.partitionBy("word").orderBy(hash_score(F.concat_ws("|", "word", "ctx", F.lit(salt))), "ctx")
    return each.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= n)


def vocabulary(lines: DataFrame, column: str = "value") -> DataFrame:
    """The distinct words of a word list, lower-cased and stripped; blank lines give none."""
    return lines.select(F.lower(strip(F.col(column))).alias("word")).filter("word <> ''").distinct()
