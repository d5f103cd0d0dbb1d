"""Teacher-labelled streams, annotator ceilings and multi-step workflows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .calibration import bin_of


def teacher_cases(records: DataFrame) -> DataFrame:
    """records (case_id, qid, labels, options, logprobs) to (case_id, qid, labels, distribution, y, from_teacher); options other than the declared labels drop the row."""
    good = records.where(F.col("labels") == F.col("options"))
    return good.withColumn("distribution", V.softmax("logprobs")).select("case_id", "qid", "labels", "distribution", V.argmax("distribution").alias("y"), F.lit(True).alias("from_teacher"))


def teacher_priors(train: DataFrame, by: list[str]) -> DataFrame:
    """(by, mode, mean): the position the teacher chose most often, the lowest on ties, and its mean distribution; train has y and distribution."""
    modes = train.groupBy(*by, "y").count().groupBy(*by).agg(F.max_by("y", F.struct("count", -F.col("y"))).alias("mode"))
    cells = train.select(*by, F.posexplode("distribution").alias("i", "p")).groupBy(*by, "i").agg(F.avg("p").alias("p"))
    means = cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]).alias("mean"))
    return modes.join(means, by)


def teacher_agreement(outcomes: DataFrame, priors: DataFrame, by: list[str], report: list[str]) -> DataFrame:
    """(report, n, agreement, base_agreement, kl, base_kl) of outcomes (by, probs, distribution, y, from_teacher) to a teacher; other labels are an error.

    A shape without a prior has the uniform distribution and position zero."""
    told = F.when(F.col("from_teacher"), True).otherwise(F.raise_error(F.lit("agreement needs teacher labels")).cast("boolean"))
    joined = outcomes.where(told).join(F.broadcast(priors), by, "left")
    uniform = F.transform("distribution", lambda p: 1.0 / F.size("distribution"))
    hit = lambda x: F.avg((x == F.col("y")).cast("double"))
    return joined.groupBy(*report).agg(
        F.count(F.lit(1)).alias("n"), hit(V.argmax("probs")).alias("agreement"), hit(F.coalesce("mode", F.lit(0))).alias("base_agreement"),
        F.avg(V.kl("distribution", "probs")).alias("kl"), F.avg(V.kl("distribution", F.coalesce("mean", uniform))).alias("base_kl"),
    )


def verify_teacher(scored: DataFrame, suite: str, qid: str) -> DataFrame:
    """(suite, qid, n, accuracy, ece) of every question of a suite, and of the suite with qid null; scored has conf and correct."""
    rows = scored.select(suite, F.explode(F.array(F.col(qid), F.lit(None).cast("string"))).alias(qid), "conf", "correct")
    bins = rows.groupBy(suite, qid, bin_of(F.col("conf")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("c"), F.sum("conf").alias("f"))
    return bins.groupBy(suite, qid).agg(F.sum("n").alias("n"), (F.sum("c") / F.sum("n")).alias("accuracy"), (F.sum(F.abs(F.col("c") - F.col("f"))) / F.sum("n")).alias("ece"))


def parse_generated(raw: DataFrame, schema: str, kinds: str, most: int = 6000) -> DataFrame:
    """Add case (the object between the first and last brace of ``text``) and reason (null: kept).

    ``schema`` must have state and questions (an array with kind and id); ``kinds`` is the column of planned kinds."""
    body = F.regexp_extract("text", r"(?s)\{.*\}", 0)
    case = raw.withColumn("case", F.from_json(body, schema))
    ids = F.col("case.questions.id")
    rules = [
        ("no object", body == ""),
        ("not JSON", F.col("case").isNull() | F.col("case.state").isNull() | F.col("case.questions").isNull()),
        ("kinds", F.col("case.questions.kind") != F.col(kinds)),
        ("id", F.exists(ids, lambda x: ~x.rlike("^[a-z][a-z0-9_]*$"))),
        ("repeated id", F.size(F.array_distinct(ids)) < F.size(ids)),
        ("long state", F.length("case.state") > most),
    ]
    return case.withColumn("reason", F.coalesce(*[F.when(c, n) for n, c in rules]))


def repair_ids(ids: Column) -> Column:
    """Ids that aren't snake case become q1, q2 and so on by position."""
    return F.transform(ids, lambda x, i: F.when(x.rlike("^[a-z][a-z0-9_]*$"), x).otherwise(F.concat(F.lit("q"), i + 1)))


def rejections(rows: DataFrame, reason: str) -> DataFrame:
    """Counts by the reason's part before its first colon."""
    return rows.where(F.col(reason).isNotNull()).groupBy(F.trim(F.substring_index(reason, ":", 1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def oracle_naive(items: DataFrame, by: list[str]) -> DataFrame:
    """items (by, distribution, y) to how often the mode of all ratings, the drawn one included, is the drawn one."""
    return items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((V.argmax("distribution") == F.col("y")).cast("double")).alias("accuracy"))


def oracle_left_out(items: DataFrame, prior: Column, by: list[str], weight: float = 2.0) -> DataFrame:
    """items (by, counts, y) to how often the others' counts and ``weight`` priors predict the drawn rating."""
    others = F.zip_with(F.transform("counts", lambda c, i: c - F.when(i == F.col("y"), 1).otherwise(0)), prior, lambda c, p: F.round(c + weight * p, 9))
    return items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((V.argmax(others) == F.col("y")).cast("double")).alias("accuracy"))


Step = tuple[str, Column, Callable[[DataFrame], DataFrame]]


def run_workflow(cases: DataFrame, steps: list[Step], key: str = "case_id") -> DataFrame:
    """``cases`` with a decision column for each step (name, condition, answer) and the number of calls.

    A step answers the cases whose condition on earlier decisions holds; ``answer`` takes those
    rows and returns (key, decision). Steps are few and fixed, so the loop only builds the plan."""
    out = cases.withColumn("calls", F.lit(0))
    for name, condition, answer in steps:
        asked = answer(out.where(condition)).select(key, F.col("decision").alias(name))
        out = out.join(asked, key, "left").withColumn("calls", F.col("calls") + F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0))
    return out


def workflow_score(done: DataFrame, pairs: dict[str, str], by: list[str], references: dict[str, str] | None = None, tokens: str | None = None, latency: str | None = None) -> DataFrame:
    """(by, n, judged, accuracy, mean_calls) and, where their columns are named, kl, mean_tokens, p50 and p99.

    Accuracy is over the decisions that were made and have a truth column. ``references`` names, for columns of
    probabilities, the column of the reference that they should have: kl is the mean divergence from it over the answers that have both."""
    met = [(F.col(d).isNotNull() & F.col(t).isNotNull(), F.col(d) == F.col(t)) for d, t in pairs.items()]
    judged = sum((F.when(m, 1).otherwise(0) for m, _ in met), F.lit(0))
    right = sum((F.when(m & e, 1).otherwise(0) for m, e in met), F.lit(0))
    sums = [F.count(F.lit(1)).alias("n"), F.sum(judged).alias("judged"), F.sum(right).alias("_r"), F.avg("calls").alias("mean_calls")]
    if references:
        both = [(F.col(p).isNotNull() & F.col(q).isNotNull(), V.kl(q, p)) for p, q in references.items()]
        sums += [F.sum(sum((F.when(m, d).otherwise(0.0) for m, d in both), F.lit(0.0))).alias("_kl"), F.sum(sum((F.when(m, 1).otherwise(0) for m, _ in both), F.lit(0))).alias("_nkl")]
    if tokens:
        sums.append(F.avg(tokens).alias("mean_tokens"))
    if latency:
        sums += [F.expr(f"percentile_disc({q}) within group (order by `{latency}`)").alias(name) for q, name in ((0.5, "p50"), (0.99, "p99"))]
    out = done.groupBy(*by).agg(*sums).withColumn("accuracy", F.try_divide("_r", "judged"))
    if references:
        out = out.withColumn("kl", F.try_divide("_kl", "_nkl"))
    return out.select(*by, "n", "judged", "accuracy", "mean_calls", *(["kl"] if references else []), *(["mean_tokens"] if tokens else []), *(["p50", "p99"] if latency else []))


def price(usage: DataFrame, by: list[str], cold: float, cached: float, prompt_rate: float, output_rate: float) -> DataFrame:
    """usage (by, first, schema, state, prompt, output) to dollars of typed and of prompted answers and their ratio.

    The first request of a schema pays for its tokens, later ones take them from the cache. Rates are dollars for a million tokens."""
    fresh = F.col("state") + F.when(F.col("first"), F.col("schema")).otherwise(0)
    reused = F.when(F.col("first"), 0).otherwise(F.col("schema"))
    typed = (F.sum(fresh) * cold + F.sum(reused) * cached) / 1e6
    prompted = (F.sum(F.col("prompt") + F.col("state")) * prompt_rate + F.sum("output") * output_rate) / 1e6
    out = usage.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), typed.alias("typed_usd"), prompted.alias("prompted_usd"))
    return out.withColumn("multiple", F.try_divide("prompted_usd", "typed_usd"))


def build_cost(shards: DataFrame, usd_per_second: float) -> DataFrame:
    """shards (kept, planned, seconds) to one row: totals, and dollars for a thousand kept cases."""
    out = shards.agg(*[F.sum(c).alias(c) for c in ("kept", "planned", "seconds")])
    return out.withColumn("usd_per_1k", 1000 * F.col("seconds") * usd_per_second / F.greatest("kept", F.lit(1)))
