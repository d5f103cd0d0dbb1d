"""Helpers that the corpus operators share: table access, shared storage, Arrow batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/verdictlake/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends in files that outlive an executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a staged table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished jobs go: Spark deletes them when the driver's garbage, which held them, is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key(df: DataFrame) -> Column:
    """A digest of all of a row's columns: rows of one key are copies in every column."""
    return F.unhex(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256))


def require_free(df: DataFrame, names: list[str]) -> None:
    """An error before any job if an output column exists already, in whatever case."""
    if clash := {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError(f"output columns already exist: {sorted(clash)}")


def crc_mod(col: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")), F.lit(n))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_chars: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into runs of rows whose texts (null: empty) together have about ``max_chars`` characters.

    A longer text makes a run of its own; it is never cut."""
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > max_chars:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t) + 1
        if start < len(texts):
            yield batch.slice(start), texts[start:]
