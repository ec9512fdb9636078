"""Spelling suggestions and transliteration candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Words up to this length are joined by what is left after deletions.
SHORT = 24


def shortened(word: Column, deletions: int, first: Column) -> Column:
    """Hashes of what is left of a word without up to so many of its characters; those before the place `first` are kept."""
    drop = lambda w: F.transform(F.sequence(first, F.greatest(F.length(w), first)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    rests = step = F.array(word)
    for _ in range(deletions):
        step = F.array_distinct(F.flatten(F.transform(step, drop)))
        rests = F.array_union(rests, step)
    return F.transform(rests, lambda r: F.xxhash64(r))


def similar_words(words: DataFrame, vocabulary: DataFrame, distance: int = 2, min_length: int = 3, n: int = 3, min_score: float = 0.6) -> DataFrame:
    """(word, rank, option, score): vocabulary within an edit distance that shares the first character.

    words: word; vocabulary: token, df. Two words that near have a common rest after as many deletions in each, so
    words are joined by their rests; those beyond SHORT characters, whose rests are many, by the first character
    among equally long tokens. Words of the vocabulary get no options. score is 1 - distance / shorter length; ties go to the more frequent, then to the smaller option.
    """
    left = words.select("word").distinct().where(F.length("word") >= min_length)
    unknown = left.join(vocabulary.select(F.col("token").alias("word")), "word", "left_anti")
    right = vocabulary.select("token", "df")
    short = lambda c: F.length(c) <= SHORT
    # What all of one first character begin with counts for no distance, so nothing of it is left out.
    ends = unknown.select("word").union(right.select("token")).groupBy(F.substring("word", 1, 1).alias("head")).agg(F.min("word").alias("low"), F.max("word").alias("high"))
    same = F.filter(F.sequence(F.lit(1), F.least(F.length("low"), F.length("high"))), lambda i: F.substring("low", F.lit(1), i) == F.substring("high", F.lit(1), i))
    ends = ends.where("head <> ''").select("head", (F.coalesce(F.array_max(same), F.lit(1)) + 1).alias("first"))

    def keys(rows: DataFrame, c: str) -> DataFrame:
        headed = rows.where(F.length(c) <= SHORT + distance).withColumn("head", F.substring(c, 1, 1)).join(F.broadcast(ends), "head")  # a row per first character
        return headed.select(*rows.columns, F.explode(shortened(F.col(c), distance, F.col("first"))).alias("key"))

    # Rests are many more than what Spark takes their size for, so neither side may be broadcast.
    near = keys(unknown.where(short("word")), "word").hint("merge").join(keys(right, "token"), "key").drop("key")
    rest = unknown.where(~short("word")).withColumn("head", F.substring("word", 1, 1)).join(right.where(F.length("token") > SHORT - distance).withColumn("head", F.substring("token", 1, 1)), "head")
    pairs = near.unionByName(rest.drop("head")).where(F.abs(F.length("word") - F.length("token")) <= distance)
    close = pairs.withColumn("d", F.levenshtein("word", "token", distance)).where(F.col("d").between(1, distance))
    scored = close.withColumn("score", 1 - F.col("d") / F.least(F.length("word"), F.length("token"))).where(F.col("score") >= min_score)
    # A pair comes once for each rest it has in common. Equal pairs are of one dense rank, so each task keeps the best n before the shuffle.
    by = W.partitionBy("word").orderBy(F.desc("score"), F.desc("df"), "token")
    best = scored.withColumn("rank", F.dense_rank().over(by)).where(F.col("rank") <= n).select("word", "token", "df", "score").distinct()
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n).select("word", "rank", F.col("token").alias("option"), "score")


def recombine(words: Column, options: Column, n: int = 3) -> Column:
    """The i-th suggestion takes each word's i-th option, its last one if it has fewer, the word itself if it has none.

    words: array of strings; options: array of arrays. Without any option there is no suggestion; repeats go.
    """
    pick = lambda i: F.array_join(F.transform(F.arrays_zip(words.alias("w"), options.alias("o")), lambda p: F.coalesce(F.get(p["o"], F.least(i, F.size(p["o"]) - 1)), p["w"])), " ")
    most = F.array_max(F.transform(options, lambda o: F.size(o)))
    return F.when(most > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.least(most, F.lit(n)) - 1), pick))).otherwise(F.array().cast("array<string>"))


def known_variants(variants: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(word, variant, freq) of variants that the corpus has, the frequent ones first."""
    return variants.join(frequencies, "variant").where("freq > 0").orderBy("word", F.desc("freq"), "variant")


def tiered_variants(variants: DataFrame, frequencies: DataFrame, first: int = 5) -> DataFrame:
    """(word, tier, variant, freq): known ones among a word's first variants, else among the rest."""
    known = variants.join(frequencies, "variant").where("freq > 0").withColumn("tier", F.when(F.col("rank") <= first, 1).otherwise(2))
    least = known.groupBy("word").agg(F.min("tier").alias("tier"))
    return known.join(least, ["word", "tier"]).select("word", "tier", "variant", "freq")


def phrases(options: list[DataFrame], k: int = 10, most: int = 3) -> DataFrame:
    """(phrase, score): all combinations of the first options of each word, scored by summed frequency; the k best.

    options: one small frame (variant, freq) per word of one query, of at most `most` rows each after the cut.
    """
    cut = [o.orderBy(F.desc("freq"), "variant").limit(most).select(F.struct("freq", "variant").alias(f"o{i}")) for i, o in enumerate(options)]
    rows = reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), cut)  # at most `most` rows on each side
    phrase = F.concat_ws(" ", *[F.col(f"o{i}.variant") for i in range(len(cut))])
    score = reduce(lambda a, b: a + b, [F.col(f"o{i}.freq") for i in range(len(cut))])
    return rows.select(phrase.alias("phrase"), score.alias("score")).orderBy(F.desc("score"), "phrase").limit(k)


def phrase_product(lists: Column) -> Column:
    """All combinations of an array of arrays of words, joined by spaces."""
    start = F.array(F.lit(""))
    add = lambda acc, options: F.flatten(F.transform(acc, lambda p: F.transform(options, lambda o: F.when(p == "", o).otherwise(F.concat_ws(" ", p, o)))))
    return F.aggregate(lists, start, add)
