"""Label pipelines: records and annotator rows to cases with questions and expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmax, uniform


def rating(value: Column, levels: int) -> Column:
    """A usable rating as int: whole, within range; anything else is null, never clipped."""
    number = value.try_cast("double")
    return F.when((F.floor(number) == number) & number.between(0, levels - 1), number.cast("int"))


def render_fields(df: DataFrame, fields: list[str], out: str = "state_text") -> DataFrame:
    """``FIELD:`` blocks joined by blank lines; null fields are empty."""
    return df.withColumn(out, F.concat_ws("\n\n", *[F.concat(F.lit(f.upper() + ":\n"), F.trim(F.coalesce(F.col(f).cast("string"), F.lit("")))) for f in fields]))


def text_choice_cases(df: DataFrame, text: str, label: str, split: str) -> DataFrame:
    """One Choice over the labels of all splits, sorted, underscores as spaces; y indexes it."""
    options = df.agg(F.array_sort(F.collect_set(F.replace(F.col(label), F.lit("_"), F.lit(" ")))).alias("options"))
    y = F.array_position("options", F.replace(F.col(label), F.lit("_"), F.lit(" "))) - 1
    return df.crossJoin(F.broadcast(options)).select(split, F.col(text).alias("state_text"), "options", y.cast("int").alias("y"))


def score_cases(df: DataFrame, keep: list[str], ratings: list[str], levels: int) -> DataFrame:
    """(keep, qid, y): one Score question for each rating; a row with an unusable rating is dropped."""
    usable = [rating(F.col(r), levels) for r in ratings]
    rows = df.select(*keep, F.array(*[F.struct(F.lit(r).alias("qid"), u.alias("y")) for r, u in zip(ratings, usable)]).alias("qs"))
    return rows.where(~F.exists("qs", lambda q: q["y"].isNull())).select(*keep, F.explode("qs").alias("q")).select(*keep, "q.*")


def distribution(ratings: Column, levels: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.size(F.filter(ratings, lambda r: r == k)) / F.size(ratings))


def annotated_cases(df: DataFrame, group: str, ratings: str, levels: int, min_raters: int = 2) -> DataFrame:
    """Items (group, ratings: array, null or out-of-range entries don't count) to raters, distribution and one drawn rating as y; too few ratings drop the item."""
    good = df.select(group, F.filter(ratings, lambda r: r.isNotNull() & (r >= 0) & (r < levels)).alias("_r")).where(F.size("_r") >= min_raters)
    drawn = F.element_at("_r", (F.floor(uniform(group, "rater") * F.size("_r")) + 1).cast("int")).cast("int")
    return good.select(group, F.size("_r").alias("raters"), distribution(F.col("_r"), levels).alias("distribution"), drawn.alias("y"))


def group_annotators(df: DataFrame, group: str, rater: str, value: Column, levels: int, min_raters: int = 2) -> DataFrame:
    """One row for each item: n raters, distribution, and one drawn rater's label.

    Raters without a usable value are left out; items below ``min_raters`` are dropped."""
    usable = df.select(group, F.col(rater).alias("_rater"), rating(value, levels).alias("_v")).where("_v is not null")
    items = usable.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_rater", "_v"))).alias("_rows")).where(F.size("_rows") >= min_raters)
    values = F.col("_rows._v")
    pick = F.floor(uniform(group, "rater") * F.size("_rows")).cast("int") + 1
    return items.select(group, F.size("_rows").alias("raters"), distribution(values, levels).alias("distribution"), F.element_at(values, pick).alias("y"))


def majority_labels(df: DataFrame) -> DataFrame:
    """The majority replaces the distribution; the lowest label on ties."""
    return df.withColumn("y", argmax("distribution")).withColumn("distribution", F.lit(None).cast("array<double>"))


def rule_label_cases(df: DataFrame, key: str, rule: Column, options: list[str], noise: float, salt: str = "noise") -> DataFrame:
    """Labels by a rule (an option's name); with probability ``noise`` the next option instead."""
    names = F.array(*[F.lit(o) for o in options])
    y = (F.array_position(names, rule) - 1).cast("int")
    flipped = F.when(uniform(key, salt) < noise, (y + 1) % len(options)).otherwise(y)
    return df.withColumn("y", flipped.cast("int")).where(y >= 0)


def noul_from_choice(cases: DataFrame, fraction: float, key: str = "case_id") -> DataFrame:
    """Yes/no questions from a share of Choices: is the answer X, X true half of the time."""
    k = F.size("options")
    other = (F.col("y") + 1 + F.floor(uniform(key, "other") * (k - 1)).cast("int")) % k
    truth = uniform(key, "truth") < 0.5
    asked = F.element_at("options", F.when(truth, F.col("y")).otherwise(other) + 1)
    return cases.where(uniform(key, "pick") < fraction).select(key, F.concat(F.lit("Is the answer "), asked, F.lit("?")).alias("question"), truth.cast("int").alias("y"))


def exclude_entities(train: DataFrame, evaluation: DataFrame, key: str) -> DataFrame:
    return train.join(evaluation.select(key).distinct(), key, "left_anti")


def split_judgements(df: DataFrame, text: str, labels: list[str], sep: str = "#") -> DataFrame:
    """Separator-joined judgements to label indices; an undeclared label drops the item."""
    names = F.array(*[F.lit(x) for x in labels])
    idx = F.transform(F.split(F.col(text), F.lit(sep)), lambda x: (F.array_position(names, F.trim(x)) - 1).cast("int"))
    return df.withColumn("ratings", idx).where(~F.exists("ratings", lambda r: r < 0))
