"""TF-IDF profiles of documents and users, and their cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnwork.functions.text import plain_words


def term_counts(df: DataFrame, document: str, text: str, stop: DataFrame, value: str = "value") -> DataFrame:
    """doc, word, tf. Stop words and documents without a key don't count."""
    rows = df.where(F.col(document) != "").select(F.col(document).alias("doc"), F.explode(plain_words(F.col(text))).alias("word"))
    return rows.join(stop.select(F.trim(value).alias("word")), "word", "left_anti").groupBy("doc", "word").agg(F.count("*").alias("tf"))


def tfidf(tf: DataFrame, documents: int, rare: float = 1e-6) -> DataFrame:
    """doc, word, score = tf / max tf * log2(documents / df), without words of at most `rare` of all occurrences."""
    stats = tf.groupBy("word").agg(F.count("*").alias("df"), F.sum("tf").alias("all"))
    total = tf.agg(F.sum("tf").alias("total"))
    most = tf.groupBy("doc").agg(F.max("tf").alias("most"))
    kept = stats.join(F.broadcast(total)).where(F.col("all") > rare * F.col("total")).select("word", "df")
    score = F.col("tf") / F.col("most") * F.log2(F.lit(float(documents)) / F.col("df"))
    return tf.join(kept, "word").join(most, "doc").select("doc", "word", F.round(score, 6).alias("score"))


def feature_words(scores: DataFrame, n: int = 200) -> DataFrame:
    """The n words of greatest score in any document: word, score, idx (from 0). At most n rows, so one task may rank them."""
    best = scores.groupBy("word").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "word").limit(n)
    return best.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("score"), "word")) - 1)


def document_profiles(tf: DataFrame, features: DataFrame) -> DataFrame:
    """doc, features (sorted array of the idx of its feature words); documents without any are left out."""
    found = tf.join(F.broadcast(features.select("word", "idx")), "word")  # at most n features
    return found.groupBy("doc").agg(F.sort_array(F.collect_set("idx")).alias("features"))


def owner_profiles(rows: DataFrame, owner: str, document: str, profiles: DataFrame) -> DataFrame:
    """owner, features: the union over the documents that the owner wrote about. Arrays hold at most as many idx as features."""
    links = rows.where((F.col(owner) != "") & (F.col(document) != "")).select(F.col(owner).alias("owner"), F.col(document).alias("doc")).distinct()
    return links.join(profiles, "doc").select("owner", F.explode("features").alias("idx")).groupBy("owner").agg(F.sort_array(F.collect_set("idx")).alias("features"))


def cosine(pairs: DataFrame, owners: DataFrame, profiles: DataFrame, least: float = 0.01) -> DataFrame:
    """owner, doc, sim = common / sqrt(product of sizes) of the given pairs, where both have a profile and sim >= least."""
    both = pairs.join(owners.select("owner", F.col("features").alias("o")), "owner").join(profiles.select("doc", F.col("features").alias("p")), "doc")
    sim = F.size(F.array_intersect("o", "p")) / F.sqrt((F.size("o") * F.size("p")).cast("double"))
    return both.select("owner", "doc", F.round(sim, 6).alias("sim")).where(F.col("sim") >= least)
