"""Similarity joins through inverted indexes: exact, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as T


def _grams(rows: DataFrame, key: str, text: str, side: str) -> DataFrame:
    sets = rows.select(F.col(key).alias(side), T.trigrams(F.col(text)).alias("set"))
    return sets.select(side, F.size("set").alias(f"n_{side}"), F.explode("set").alias("gram"))


def trigram_join(left: DataFrame, right: DataFrame, key: str, text: str, least: float = 0.0) -> DataFrame:
    """(left_key, right_key, shared, similarity) of all pairs that share a trigram and reach `least`.

    An equi-join on trigrams counts what two texts share; pairs without one have similarity 0 and are never made.
    Give distinct texts on both sides and join repeats back afterwards.
    """
    a, b = _grams(left, key, text, "left_key"), _grams(right, key, text, "right_key")
    shared = a.join(b, "gram").groupBy("left_key", "right_key", "n_left_key", "n_right_key").agg(F.count(F.lit(1)).alias("shared"))
    similarity = F.col("shared") / (F.col("n_left_key") + F.col("n_right_key") - F.col("shared"))
    return shared.withColumn("similarity", similarity).where(F.col("similarity") >= least).select("left_key", "right_key", "shared", "similarity")


def word_join(left: DataFrame, right: DataFrame, word: str = "word", least: float = T.TOKEN_MATCH) -> DataFrame:
    """(left_word, right_word, score) of distinct words as alike as word_similarity says: spelling or skeleton.

    Two equi-joins, on trigrams (whose shared number gives the similarity) and on skeletons; words with neither in
    common have similarity 0 and make no pair.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        words = rows.select(F.col(word).alias(name)).distinct()
        return words.select(name, T.word_trigrams(F.col(name)).alias("grams"), T.skeleton(F.col(name)).alias("bones"))

    a, b = side(left, "left_word"), side(right, "right_word")
    grams = lambda df, c, n: df.select(c, F.size("grams").alias(n), F.explode("grams").alias("gram"))
    shared = grams(a, "left_word", "n_a").join(grams(b, "right_word", "n_b"), "gram").groupBy("left_word", "right_word", "n_a", "n_b").agg(F.count(F.lit(1)).alias("c"))
    spelled = shared.select("left_word", "right_word", (F.col("c") / (F.col("n_a") + F.col("n_b") - F.col("c"))).alias("plain"), F.lit(False).alias("alike"))
    long = F.length("bones") >= 3
    boned = a.where(long).select("left_word", "bones").join(b.where(long).select("right_word", "bones"), "bones").select("left_word", "right_word", F.lit(0.0).alias("plain"), F.lit(True).alias("alike"))
    pairs = spelled.unionByName(boned).groupBy("left_word", "right_word").agg(F.max("plain").alias("plain"), F.bool_or("alike").alias("alike"))
    score = F.when((F.col("plain") < T.SKELETON_MATCH) & F.col("alike"), F.lit(T.SKELETON_MATCH)).otherwise(F.col("plain"))
    return pairs.select("left_word", "right_word", score.alias("score")).where(F.col("score") >= least)
