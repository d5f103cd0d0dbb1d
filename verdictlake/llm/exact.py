"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

1. A Misra-Gries summary of the texts' SHA-256 digests (Spark's ``approx_top_k``:
   mergeable counters, partial on the map side) names the digests that may hold 1 /
   ``tracked`` of the rows or more, at most ``tracked`` of them; no such digest is missed.
   The result is right whichever digests it names.
2. The candidates are counted exactly and their winner is found with map-side partial
   sums. These at most ``tracked`` rows are broadcast, and rows of frequent digests are
   settled map-side.
3. Every other digest has few rows; an ordinary shuffle by digest settles it.

Edge cases: a null text counts as empty; a very long text is hashed whole; a null id loses against any other and
stays only in a group without ids; repeated rows with the winning id are all
flagged ``kept``. ``dedup_exact`` leaves one row of each text: that of the largest id,
of several with this id the one whose digest over all columns is smallest. An empty table
gives an empty result; other columns pass through under any name, a clash with an output
column of ``exact_groups`` is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require_free, row_key

OUT = ("keep_id", "group_size", "kept", "text_sha256")
TRACKED = 1024


def text_digest(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def frequent(df: DataFrame, column: str, tracked: int = TRACKED) -> DataFrame:
    """The values of ``column`` that may hold 1 / ``tracked`` of the rows, at most ``tracked`` of them, one row each."""
    top = df.agg(F.expr(f"approx_top_k(`{column}`, {tracked}, {8 * tracked})").alias("top"), F.count(F.lit(1)).alias("rows"))
    return top.select("rows", F.explode("top").alias("t")).where(F.col("t.count") * tracked >= F.col("rows")).select(F.col("t.item").alias(column)).where(F.col(column).isNotNull())


def exact_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", tracked: int = TRACKED) -> DataFrame:
    """Every row of ``df`` without its text, with keep_id, group_size, kept and text_sha256."""
    rest = [c for c in df.columns if c != text]
    require_free(df.select(*rest), list(OUT))
    rows = df.select(*rest, text_digest(text).alias("text_sha256"))
    digests = rows.select(F.col(id_col).alias("keep_id"), "text_sha256")
    group = [F.max("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    heavy = digests.join(F.broadcast(frequent(digests, "text_sha256", tracked)), "text_sha256", "left_semi").groupBy("text_sha256").agg(*group)
    marked = rows.join(F.broadcast(heavy), "text_sha256", "left")
    same = Window.partitionBy("text_sha256")
    settled = marked.where(F.col("group_size").isNotNull())
    others = marked.where(F.col("group_size").isNull()).withColumns({"keep_id": F.max(id_col).over(same), "group_size": F.count(F.lit(1)).over(same)})
    return settled.unionByName(others).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id"))).select(*rest, *OUT)


def dedup_exact(df: DataFrame, id_col: str = "doc_id", text: str = "text", tracked: int = TRACKED) -> DataFrame:
    """The rows of ``df`` that stay, one for each distinct text, with the columns of ``df``.

    Texts are shuffled once: of frequent digests only copies of the winner leave the map side."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), text_digest(text).alias("digest"), row_key(df).alias("key"))
    small = rows.select("digest", "id", "key")
    named = small.join(F.broadcast(frequent(small, "digest", tracked)), "digest", "left_semi")
    largest = named.groupBy("digest").agg(F.max("id").alias("top"))
    heavy = named.join(F.broadcast(largest), "digest").where(F.col("id").eqNullSafe(F.col("top"))).groupBy("digest").agg(F.min("key").alias("winner"))
    left = rows.join(F.broadcast(heavy), "digest", "left").where(F.col("winner").isNull() | (F.col("winner") == F.col("key")))
    best = Window.partitionBy("digest").orderBy(F.col("id").desc_nulls_last(), "key")
    return left.withColumn("place", F.row_number().over(best)).where("place = 1").select("row.*")
