"""Sampling, splits and contamination control. Every choice is a keyed draw, so it doesn't depend on partitioning."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import uniform

#: rows that one task ranks
RANKED = 500_000


def hash_rank(df: DataFrame, key: str, salt: str, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Add the place, from one, of every row in the order of a keyed draw (of its ``by``).

    Draws are cut into ranges of about RANKED rows; a range is ranked in one task and the counts of the ranges
    before it, a row each, are added, so that no task ranks a whole group."""
    by = by or []
    ranges = df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / RANKED)).alias("_g"))
    cut = df.crossJoin(F.broadcast(ranges)).withColumn("_u", uniform(key, salt)).withColumn("_c", F.floor(F.col("_u") * F.col("_g")))
    sizes = cut.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = cut.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_c").orderBy("_u", key)))
    return placed.join(offsets, [*by, "_c"]).withColumn(out, F.col("_before") + F.col("_place")).select(*df.columns, out)


def hash_holdout(df: DataFrame, key: str, fraction: float, salt: str = "holdout") -> DataFrame:
    return df.withColumn("held_out", uniform(F.trim(F.col(key).cast("string")), salt) < fraction)


def split_named(df: DataFrame, key: str, weights: dict[str, float], salt: str = "split") -> DataFrame:
    """Disjoint named splits in proportion to ``weights``."""
    u, ends = uniform(key, salt) * sum(weights.values()), list(accumulate(weights.values()))
    name = F.lit(list(weights)[-1])
    for w, end in reversed(list(zip(weights, ends))[:-1]):
        name = F.when(u < end, w).otherwise(name)
    return df.withColumn("split", name)


def sample_per_slice(df: DataFrame, by: list[str], key: str, n: int, salt: str = "sample") -> DataFrame:
    order = Window.partitionBy(*by).orderBy(uniform(key, salt), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def one_per_case(df: DataFrame, case: str, kind: str, qid: str, salt: str = "one") -> DataFrame:
    order = Window.partitionBy(case, kind).orderBy(uniform(F.concat_ws("|", case, qid), salt), qid)
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def balance_by_label(df: DataFrame, label: str, key: str, salt: str = "balance") -> DataFrame:
    """All rows of the rarest label and as many of every other, by hash rank."""
    least = df.groupBy(label).count().agg(F.min("count").alias("_least"))
    return hash_rank(df, key, salt, [label], "_r").crossJoin(F.broadcast(least)).where(F.col("_r") <= F.col("_least")).drop("_r", "_least")


def carve_splits(train: DataFrame, test: DataFrame, key: str, calibration_n: int, min_eval: int, salt: str = "carve") -> DataFrame:
    """Rows of both with their split: a calibration set of at most a quarter of ``train``, and an evaluation set that unused
    rows top up to ``min_eval``, never by more than half of what is left."""
    n, m = train.agg(F.count(F.lit(1)).alias("_n")), test.agg(F.count(F.lit(1)).alias("_m"))
    ranked = hash_rank(train, key, salt, out="_r").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(m))
    calibration = F.least(F.lit(calibration_n), F.floor(F.col("_n") / 4))
    top_up = F.least(F.greatest(F.lit(0), min_eval - F.col("_m")), F.floor((F.col("_n") - calibration) / 2))
    split = F.when(F.col("_r") <= calibration, "calibration").when(F.col("_r") <= calibration + top_up, "eval").otherwise("train")
    return ranked.select(*train.columns, split.alias("split")).unionByName(test.withColumn("split", F.lit("eval")))


def mix(cases: DataFrame, corpus: str, key: str, quotas: dict[str, tuple[int, int]], domain: str, held_out: list[str], salt: str = "mix") -> DataFrame:
    """cases with split train or calibration: for each corpus its quota of (training, calibration) rows by hash rank, whole domains left out.

    A calibration quota is zero where labels are no evidence, and at most a quarter of the corpus's rows."""
    table = F.create_map(*[x for c, (t, k) in quotas.items() for x in (F.lit(c), F.struct(F.lit(t).alias("train"), F.lit(k).alias("calibration")))])
    rows = cases.where(F.col(corpus).isin(list(quotas)) & ~F.col(domain).isin(held_out))
    size = rows.groupBy(corpus).agg(F.count(F.lit(1)).alias("_n"))
    ranked = hash_rank(rows, key, salt, [corpus], "_r").join(F.broadcast(size), corpus)
    quota = F.element_at(table, F.col(corpus))
    calibration = F.least(quota["calibration"], F.floor(F.col("_n") / 4))
    split = F.when(F.col("_r") <= calibration, "calibration").when(F.col("_r") <= calibration + quota["train"], "train")
    return ranked.select(*cases.columns, split.alias("split")).where("split is not null")


def dump_texts(cases: DataFrame, text: str) -> DataFrame:
    """The distinct trimmed texts in order: what training has to stay clear of."""
    return cases.select(F.trim(text).alias(text)).where(F.col(text).isNotNull()).distinct().orderBy(text)


def limit_cases(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` built rows in the order of ``key``."""
    return df.orderBy(key).limit(n)


def pack_budget(df: DataFrame, batch: str, order: str, length: str, budget: int) -> DataFrame:
    """(batch, order, part): consecutive parts of a batch whose rows times longest squared fit the budget, of one row at least.

    A batch is a few steps of rows by construction, so its fold runs over one array."""
    rows = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(order, length))).alias("_rows"))
    start = F.struct(F.lit(-1).alias("part"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("wide"), F.array().cast("array<int>").alias("out"))

    def add(acc, row):
        wide = F.greatest(acc["wide"], row[length].cast("long"))
        over = (acc["size"] == 0) | ((acc["size"] + 1) * wide * wide > budget)
        part = F.when(over, acc["part"] + 1).otherwise(acc["part"])
        return F.struct(part.alias("part"), F.when(over, 1).otherwise(acc["size"] + 1).alias("size"), F.when(over, row[length].cast("long")).otherwise(wide).alias("wide"), F.concat(acc["out"], F.array(part)).alias("out"))

    parts = rows.select(batch, "_rows", F.aggregate("_rows", start, add, lambda acc: acc["out"]).alias("_parts"))
    return parts.select(batch, F.explode(F.arrays_zip(F.col("_rows").getField(order).alias("o"), F.col("_parts").alias("p"))).alias("x")).select(batch, F.col("x.o").alias(order), F.col("x.p").alias("part"))


def first_per_group(df: DataFrame, by: str, pos: str, n: int) -> DataFrame:
    rest = [c for c in df.columns if c != by]
    first = df.groupBy(by).agg(F.min_by(F.struct(*rest), pos).alias("_s"))
    return first.select(by, "_s.*").select(*df.columns).orderBy(pos, by).limit(n)


def exclude_texts(cases: DataFrame, texts: DataFrame, text: str, case: str) -> DataFrame:
    """Cases none of whose trimmed texts is among ``texts`` (column of the same name)."""
    known = texts.select(F.sha2(F.trim(text), 256).alias("_h")).distinct()
    bad = cases.select(case, F.sha2(F.trim(text), 256).alias("_h")).join(known, "_h", "left_semi").select(case).distinct()
    return cases.join(bad, case, "left_anti")


def pending(plans: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return plans.join(done.select(key).distinct(), key, "left_anti")


def bucket_batches(df: DataFrame, key: str, length: str, step: int, window: int, salt: str = "batch") -> DataFrame:
    """(.., batch): a shuffled order cut into windows, sorted by length within a window, cut into steps.

    The shuffled order is a hash; windows are hash ranges of about ``window`` rows, so no global sort is needed."""
    groups = df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / window)).alias("_g"))
    dealt = df.crossJoin(F.broadcast(groups)).withColumn("_w", F.floor(uniform(key, salt) * F.col("_g")))
    place = F.row_number().over(Window.partitionBy("_w").orderBy(length, key)) - 1
    return dealt.withColumn("batch", F.concat_ws("-", "_w", F.floor(place / step))).drop("_g", "_w")


def generation_plan(spark, n: int, seed: int, domains: list[str]) -> DataFrame:
    """Plans 0 to n - 1: a domain in rotation and drawn question counts and kinds."""
    base = spark.range(n).withColumnRenamed("id", "index")
    key = F.concat_ws("|", F.lit(seed), "index")
    kinds = F.array(*[F.lit(k) for k in ("choice", "score", "noul")])
    return base.withColumns({"domain": F.element_at(F.array(*[F.lit(d) for d in domains]), (F.col("index") % len(domains) + 1).cast("int")), "questions": (F.floor(uniform(key, "count") * 3) + 1).cast("int")}).withColumn(
        "kinds", F.transform(F.sequence(F.lit(1), F.col("questions")), lambda i: F.element_at(kinds, (F.floor(uniform(F.concat_ws("|", key, i), "kind") * 3) + 1).cast("int")))
    )
