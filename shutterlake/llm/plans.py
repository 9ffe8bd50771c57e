"""Queries of the subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from shutterlake.llm import clusters

    return clusters.clustered(_table(spark, d, "cluster_input"), "face_id", "embedding").select("cluster_key", F.col("id").alias("face_id"))


def p2_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical faces of each group."""
    from shutterlake.llm import clusters

    return clusters.profiles(_table(spark, d, "cluster_input"), "face_id", "embedding").withColumnRenamed("id", "face_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from shutterlake.llm import canonical

    rows = _table(spark, d, "photos").select(F.col("id").alias("key"), F.col("camera_make").alias("make"), F.col("camera_model").alias("model"))
    return canonical.mapped(rows, _table(spark, d, "camera_catalog")).select(F.col("key").alias("photo_id"), "catalog_id").distinct()


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that mean no entry, with the number of photos."""
    from shutterlake.llm import canonical

    rows = _table(spark, d, "photos").select(F.col("id").alias("key"), F.col("camera_make").alias("make"), F.col("camera_model").alias("model"))
    m = canonical.mapped(rows, _table(spark, d, "camera_catalog")).where("catalog_id = 0")
    return m.groupBy("make", "model").agg(F.countDistinct("key").alias("n_photos"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from shutterlake.llm import neighbours

    found = neighbours.most_similar(_table(spark, d, "cluster_input"), "face_id", "embedding")
    return neighbours.pairs(found).select(F.col("a").alias("face_a"), F.col("b").alias("face_b"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    from shutterlake.llm import tokens

    return tokens.encoded(_table(spark, d, "documents"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    from shutterlake.llm import mixing, tokens

    docs = _table(spark, d, "documents").select("doc_id", "source", F.col("text"), F.col("text").alias("body"))
    sized = tokens.encoded(docs, keep=["doc_id", "source", "body"], count_only=True)
    sized = sized.select("doc_id", "source", "n_tokens", mixing.quality_weight(F.col("body"), F.col("n_tokens")).alias("weight"))
    return mixing.mixture(sized, _table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    from shutterlake.llm import mixing

    return mixing.actual_shares(_mixed(spark, d), _table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from shutterlake.llm import encoding

    return encoding.repaired(_table(spark, d, "documents")).select("doc_id", "restored_md5")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found, "p2_profiles": p2_profiles, "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p6_found": p6_found, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found,
}
SQL: dict[str, str] = {}
