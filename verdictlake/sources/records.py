"""Corpus scans with explicit schemas, pins, and report sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_records(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """CSV, TSV, JSON lines (plain or gzipped) or Parquet by suffix; several files are one pool."""
    name = paths[0].removesuffix(".gz")
    reader = spark.read.schema(schema)
    if name.endswith(".csv"):
        return reader.csv(paths, header=True, multiLine=True, escape='"')
    if name.endswith(".tsv"):
        return reader.csv(paths, header=True, sep="\t")
    if name.endswith((".jsonl", ".ndjson")):
        return reader.json(paths)
    if name.endswith(".parquet"):
        return reader.parquet(*paths)
    raise ValueError(f"unknown suffix: {paths[0]}")


def read_json_doc(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array or object a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def verify_pins(spark: SparkSession, path: str, pins: DataFrame) -> DataFrame:
    """(file, sha256, expected) of the files under ``path`` whose digest isn't the pinned one."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    return found.join(pins.withColumnRenamed("sha256", "expected"), "file", "left").where(~F.col("sha256").eqNullSafe(F.col("expected")))


def convert(df: DataFrame, columns: list[str], path: str) -> None:
    """Only ``columns``, NaN as null, to gzipped JSON lines; a missing column is an error."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    kinds = dict(df.dtypes)
    df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns]).write.json(path, compression="gzip")


def read_positioned(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of one file with pos, the line's number from zero among those that aren't blank.

    Splits of a file are numbered in its order; a count for each split, a row each, turns places within a split into places in the file."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    numbered = lines.select("value", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_k"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = numbered.join(F.broadcast(offsets), "_p").select((F.col("_before") + F.col("_k")).alias("pos"), F.from_json("value", schema).alias("_r"))
    return placed.select("pos", "_r.*")


def align(requests: DataFrame, labels: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows that belong together by position; a position that one side lacks is an error when the result is read."""
    a, b = (df.withColumn(c, F.lit(True)) for df, c in ((requests, "_a"), (labels, "_b")))
    both = a.join(b, pos, "full")
    told = F.raise_error(F.concat(F.lit("requests and labels differ in number: position "), F.col(pos).cast("string")))
    return both.where(F.when(F.col("_a") & F.col("_b"), True).otherwise(told.cast("boolean"))).drop("_a", "_b")


def read_aligned(spark: SparkSession, requests: str, labels: str, request_schema: str, label_schema: str) -> DataFrame:
    """Two files of JSON lines joined line by line."""
    return align(read_positioned(spark, requests, request_schema), read_positioned(spark, labels, label_schema))


GATE = "array<struct<name:string,value:double,limit:double,passed:boolean,advisory:boolean>>"


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Report files, one JSON object each, as (runs, gates): the verdict comes from the file, the blocking failures from its gates."""
    raw = spark.read.schema(f"seed long, final_loss double, passed boolean, gates {GATE}").json(path, multiLine=True).withColumn("run", F.col("_metadata.file_name"))
    blocking = F.filter("gates", lambda g: ~g["passed"] & ~F.coalesce(g["advisory"], F.lit(False)))
    runs = raw.select("run", "seed", "final_loss", "passed", F.transform(blocking, lambda g: g["name"]).alias("blocked"))
    return runs, raw.select("run", "seed", F.explode("gates").alias("g")).select("run", "seed", "g.*")


def read_answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved answers, one JSON file a case, with case_id from the file's name; ``splits.pending`` says which are still to be asked."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("case_id", F.regexp_replace(F.url_decode(name), r"\.json(\.gz)?$", ""))


#: bytes of shard files that go into one merged part
PART_BYTES = 256_000_000


def merge_shards(spark: SparkSession, shards: str, out: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The lines of all shard files in order of shard and line, as gzipped parts below ``out`` whose names sort in that order; (file, sha256) of each.

    Each part is a range of lines in a task of its own, so the merge grows with the number of parts; read in order of name they
    are the one file that the shards make, and the manifest of their digests pins it. A small merge is one part."""
    size = spark.read.format("binaryFile").load(shards).agg(F.sum("length")).first()[0] or 0
    lines = spark.read.text(shards).select(F.col("_metadata.file_name").alias("shard"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_k"), "value").where(F.trim("value") != "")
    parts = max(1, -(-size // part_bytes))
    lines.repartitionByRange(parts, "shard", "_p", "_k").sortWithinPartitions("shard", "_p", "_k").select("value").write.mode("overwrite").text(out, compression="gzip")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(out).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


VERSIONS = "name string, number int, version string"


def save_params(params: dict[str, DataFrame], path: str) -> None:
    """Fitted parameters as one Parquet table a kind: temperatures, knots, thresholds.

    A table is written as a new version first; a row appended to ``versions`` then makes it the current one. A reader meets the
    version before or the new one, never a part of either."""
    for name, df in params.items():
        spark = df.sparkSession
        spark.createDataFrame([], VERSIONS).write.mode("append").parquet(f"{path}/versions")
        known = spark.read.schema(VERSIONS).parquet(f"{path}/versions").where(F.col("name") == name)
        number = (known.agg(F.max("number")).first()[0] or 0) + 1
        version = uuid.uuid4().hex
        df.write.parquet(f"{path}/{name}/{version}")
        spark.createDataFrame([(name, number, version)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")


def load_params(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The current version of each table; an error for a name that was never saved."""
    current = spark.read.schema(VERSIONS).parquet(f"{path}/versions").groupBy("name").agg(F.max_by("version", F.struct("number", "version")).alias("version"))
    where = {r.name: r.version for r in current.where(F.col("name").isin(names)).collect()}
    if missing := set(names) - set(where):
        raise ValueError(f"no parameters were saved as {sorted(missing)}")
    return {n: spark.read.parquet(f"{path}/{n}/{where[n]}") for n in names}


#: metric rows of the largest report that is put into words
REPORT_ROWS = 100_000


def report_rows(gates: DataFrame, suites: DataFrame, slices: DataFrame) -> DataFrame:
    """gates (gate, value, limit, passed, advisory), suites (suite, metrics), slices (slice, metrics) as long rows (part, name, metric, value, passed, advisory)."""

    def long(df: DataFrame, part: str, name: str) -> DataFrame:
        rest = [c for c, t in df.dtypes if c != name and t in ("double", "float", "bigint", "int")]
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in rest])
        none = F.lit(None).cast("boolean")
        return df.select(F.lit(part).alias("part"), F.col(name).alias("name"), F.explode(cells).alias("c"), none.alias("passed"), none.alias("advisory")).select("part", "name", "c.*", "passed", "advisory")

    g = gates.select(F.lit("gate").alias("part"), F.col("gate").alias("name"), F.lit("value").alias("metric"), "value", "passed", "advisory")
    return g.unionByName(long(suites, "suite", "suite")).unionByName(long(slices, "slice", "slice"))


def write_report(gates: DataFrame, suites: DataFrame, slices: DataFrame, path: str) -> bool:
    """The report as JSON rows under ``path``/rows and as Markdown under ``path``/text; whether all blocking gates pass.

    The rows are written once; verdict and text are made from what was written, a row for each metric."""
    spark = gates.sparkSession
    rows = report_rows(gates, suites, slices)
    rows.write.mode("overwrite").json(f"{path}/rows")
    written = spark.read.schema(rows.schema).json(f"{path}/rows")
    if (n := written.count()) > REPORT_ROWS:
        raise ValueError(f"a report of {n} rows is no text; its rows are below {path}/rows")
    back = written.orderBy("part", "name", "metric").collect()
    failed = [r.name for r in back if r.part == "gate" and not r.passed and not r.advisory]
    text = [f"# Report: {'passed' if not failed else 'blocked by ' + ', '.join(failed)}", ""]
    for part, head in (("gate", "| Gate | Value | Result |"), ("suite", "| Suite | Metric | Value |"), ("slice", "| Slice | Metric | Value |")):
        text += [head, "| --- | --- | --- |"]
        for r in (x for x in back if x.part == part):
            value = "" if r.value is None else f"{r.value:.4f}"
            result = ("advisory " if r.advisory else "") + ("pass" if r.passed else "fail")
            text.append(f"| {r.name} | {value} | {result} |" if part == "gate" else f"| {r.name} | {r.metric} | {value} |")
        text.append("")
    spark.createDataFrame([("\n".join(text),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/text")
    return not failed


def reliability_diagram(bins: DataFrame, width: int = 40) -> DataFrame:
    """Bins with their signed gap and a bar of the accuracy."""
    size = F.round(F.col("acc") * width).cast("int")
    return bins.withColumns({"gap": F.col("acc") - F.col("conf"), "bar": F.rpad(F.repeat(F.lit("#"), size), width, ".")})
