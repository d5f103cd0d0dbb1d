"""Scored answers, annotator rows and texts derived from the driver's tables by arithmetic that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_scored(spark: SparkSession, sf_dir: str, salt: str = "l", lift: float = 1.2) -> DataFrame:
    """Each event as a Choice among the event types, with drawn logits that favour the truth."""
    events = table(spark, sf_dir, "events")
    kinds = events.agg(F.array_sort(F.collect_set("event_type")).alias("labels"))
    base = events.crossJoin(F.broadcast(kinds)).withColumn("y", (F.array_position("labels", F.col("event_type")) - 1).cast("int"))

    def logit(i: Column) -> Column:
        text = F.concat(F.lit(salt), i.cast("string"), F.lit("|"), F.col("event_id").cast("string"))
        u = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / 4294967296.0
        return 3 * u + F.when(i == F.col("y"), lift).otherwise(0.0)

    logits = F.transform(F.sequence(F.lit(0), F.size("labels") - 1), logit)
    out = base.select(F.col("event_id").alias("case_id"), F.lit("q").alias("qid"), F.lit("choice").alias("kind"), (F.col("user_id") % 7).cast("string").alias("domain"), "user_id", "ts", "labels", logits.alias("logits"), "y")
    return out.withColumn("probs", V.softmax("logits"))


def vector_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a Choice among ten labels."""
    v = table(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 8)
    return v.select(F.col("vec_id").alias("case_id"), F.lit("all").alias("domain"), logits.alias("logits"), F.col("label").alias("y")).withColumn("probs", V.softmax("logits"))


def annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as raters of their order: (item, rater, rating 0 to 4)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("rater"), F.pmod(F.floor("l_quantity"), F.lit(5)).cast("int").alias("rating"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as the options of one set: idx from zero in order of item_id."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), "text")


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event answered twice: an anchor, and a variant whose logits favour the truth less."""
    cols = ["case_id", "domain", "probs", "y"]
    a = event_scored(spark, sf_dir).select(F.col("case_id").alias("pair_id"), *cols[1:], F.lit("anchor").alias("role"))
    v = event_scored(spark, sf_dir, "v", 0.6).select(F.col("case_id").alias("pair_id"), *cols[1:], F.lit("variant").alias("role"))
    return a.unionByName(v)
