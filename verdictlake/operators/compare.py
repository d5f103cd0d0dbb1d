"""Joins and comparisons between systems, robustness pairs and decision output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def compare_systems(answers: DataFrame) -> DataFrame:
    """answers (system, slice, case_id, correct) to (system, slice, n, accuracy), on the cases that every system of the slice answered.

    Answers meet once, by case; a case's row holds no more entries than there are answers to it."""
    cases = answers.groupBy("slice", "case_id").agg(F.collect_list(F.struct("system", F.col("correct").cast("double").alias("correct"))).alias("_a"))
    # the same exchange serves both uses of ``cases``
    need = cases.select("slice", F.explode("_a.system").alias("_s")).groupBy("slice").agg(F.count_distinct("_s").alias("_need"))
    common = cases.join(need, "slice").where(F.size(F.array_distinct("_a.system")) == F.col("_need"))
    return common.select("slice", F.explode("_a").alias("a")).groupBy("a.system", "slice").agg(F.count(F.lit(1)).alias("n"), F.avg("a.correct").alias("accuracy"))


def macro(rows: DataFrame) -> DataFrame:
    return rows.groupBy("system").agg(F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("slices"))


def migration_diff(ours: DataFrame, theirs: DataFrame, by: list[str]) -> DataFrame:
    """(case_id, qid, decision, confidence) twice to n, agreement and the mean confidence of either side for each of ``by``."""
    both = ours.join(theirs.select("case_id", "qid", F.col("decision").alias("_theirs"), F.col("confidence").alias("_confidence")), ["case_id", "qid"])
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("decision") == F.col("_theirs")).cast("double")).alias("agreement"), F.avg("confidence").alias("our_confidence"), F.avg("_confidence").alias("their_confidence")
    )


def disagreements(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(case_id, qid, decision, confidence, theirs, their_confidence) where the decisions differ."""
    other = theirs.select("case_id", "qid", F.col("decision").alias("theirs"), F.col("confidence").alias("their_confidence"))
    return ours.select("case_id", "qid", "decision", "confidence").join(other, ["case_id", "qid"]).where("decision <> theirs")


def migration_verdict(ours: DataFrame, theirs: DataFrame, truth: DataFrame) -> DataFrame:
    """On disagreements with a label: ours right, theirs right, both wrong."""
    both = ours.join(theirs.select("case_id", "qid", F.col("decision").alias("_theirs")), ["case_id", "qid"]).where("decision <> _theirs").join(truth, ["case_id", "qid"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == F.col("truth")).alias("ours_right"), F.count_if(F.col("_theirs") == F.col("truth")).alias("theirs_right"), F.count_if((F.col("decision") != F.col("truth")) & (F.col("_theirs") != F.col("truth"))).alias("both_wrong"))


def parity(local: DataFrame, served: DataFrame, key: list[str]) -> DataFrame:
    """One row: n, answers without a partner, share of equal decisions, largest difference of a probability, and whether all limits hold.

    local, served (key, labels, probs). Answers to one key with different labels can't be compared: that is an error."""
    both = local.select(*key, "labels", "probs").join(served.select(*key, F.col("labels").alias("_labels"), F.col("probs").alias("_p")), key, "full")
    told = F.raise_error(F.concat(F.lit("different labels: "), F.concat_ws("|", *key)))
    met = F.col("probs").isNotNull() & F.col("_p").isNotNull()
    sound = both.where(F.when(met & (F.col("labels") != F.col("_labels")), told.cast("boolean")).otherwise(F.lit(True)))
    same = F.when(met, (V.argmax("probs") == V.argmax("_p")).cast("double"))
    diff = F.array_max(F.zip_with("probs", "_p", lambda a, b: F.abs(a - b)))
    out = sound.agg(F.count_if(met).alias("n"), F.count_if(~met).alias("alone"), F.avg(same).alias("agreement"), F.max(F.when(met, diff)).alias("max_diff"))
    return out.withColumn("passed", (F.col("alone") == 0) & (F.col("agreement") >= 0.98) & (F.col("max_diff") <= 0.05))


def invariance(one: DataFrame, two: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """(by, n, agreement): how often two answers (key, by, options, probs) under different option orders choose the option of one name.

    Pairs of which a side is missing or null don't count."""
    name = lambda df, out: df.select(*key, *by, F.element_at("options", V.argmax("probs") + 1).alias(out))
    both = name(one, "_a").join(name(two, "_b").drop(*by), key).where("_a is not null and _b is not null")
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement"))


def pair_same(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs (pair_id, role anchor or variant, probs, y) to flip rate, mean drift and accuracies."""
    rows = pairs.groupBy(*by, "pair_id").agg(*[F.max_by(c, F.col("role") == r).alias(f"{r}_{c}") for r in ("anchor", "variant") for c in ("probs", "y")])
    a, v = V.argmax("anchor_probs"), V.argmax("variant_probs")
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((a != v).cast("double")).alias("flip_rate"), F.avg(V.total_variation("anchor_probs", "variant_probs")).alias("drift"),
        F.avg((a == F.col("anchor_y")).cast("double")).alias("anchor_accuracy"), F.avg((v == F.col("variant_y")).cast("double")).alias("variant_accuracy"),
    )
    return out.withColumn("drop", F.col("anchor_accuracy") - F.col("variant_accuracy"))


def pair_complement(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs (pair_id, role affirm or deny, p_yes) to mean and largest incoherence and the share within 0.05."""
    gap = F.abs(F.sum("p_yes") - 1)
    each = pairs.groupBy(*by, "pair_id").agg(gap.alias("gap"))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"), F.avg((F.col("gap") <= 0.05).cast("double")).alias("coherent"))


def reorder(cases: DataFrame, key: str = "case_id", salt: str = "order") -> DataFrame:
    """Options in a keyed order, with the label following its option."""
    order = F.array_sort(F.transform("options", lambda o, i: F.struct(V.uniform(F.concat_ws("|", F.col(key).cast("string"), i), salt).alias("u"), i.alias("i"), o.alias("o"))))
    return cases.withColumn("_o", order).withColumns({"options": F.col("_o.o"), "y": (F.array_position("_o.i", F.col("y")) - 1).cast("int")}).drop("_o")


def present_top_k(df: DataFrame, k: int) -> DataFrame:
    """Add shown (ascending indices), mass and truncated; probabilities aren't rescaled."""
    shown = V.top_k("probs", k)
    return df.withColumn("shown", shown).withColumns({"mass": V.total(F.transform("shown", lambda i: F.element_at("probs", i + 1))), "truncated": F.size("probs") > k})


def escalate(workhorse: DataFrame, premium: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """Premium probabilities where the workhorse's confidence is below the threshold; escalated says which."""
    own = workhorse.withColumn("escalated", V.choice_confidence("probs") < threshold)
    joined = own.join(premium.select(*key, F.col("probs").alias("_p")), key, "left")
    return joined.withColumn("probs", F.when(F.col("escalated"), F.coalesce("_p", "probs")).otherwise(F.col("probs"))).drop("_p")


def cache_accounting(requests: DataFrame, key: str, ts: str, tokens: str, order: str) -> DataFrame:
    """(key, calls, hits, billed, computed): the first request of a key computes its tokens, later ones are served.

    Sums need the first request only, so this is one aggregation and no window."""
    first = F.min_by(tokens, F.struct(ts, order))
    return requests.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), (F.count(F.lit(1)) - 1).alias("hits"), F.sum(tokens).alias("billed"), first.alias("computed"))


def serving_cost(logs: DataFrame, by: list[str], latency: str, tokens: str, usd_per_hour: float) -> DataFrame:
    rows = logs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.expr(f"percentile_disc(0.5) within group (order by {latency})").alias("p50"), F.expr(f"percentile_disc(0.99) within group (order by {latency})").alias("p99"), F.sum(latency).alias("ms"), F.sum(tokens).alias("tokens")
    )
    return rows.select(*by, "requests", "p50", "p99", (F.col("ms") / 3.6e6 * usd_per_hour / F.col("tokens") * 1e6).alias("usd_per_mtok"))


def split_half(ratings: DataFrame, item: str, rater: str, value: str) -> DataFrame:
    """One row: items of four raters or more, and how often the rounded means of two keyed halves agree."""
    order = Window.partitionBy(item).orderBy(V.uniform(F.concat_ws("|", item, rater), "half"), rater)
    dealt = ratings.withColumns({"_r": F.row_number().over(order), "_n": F.count(F.lit(1)).over(Window.partitionBy(item))}).where("_n >= 4")
    means = dealt.groupBy(item).agg(*[F.floor(F.avg(F.when(F.col("_r") % 2 == h, F.col(value))) + 0.5).alias(f"h{h}") for h in (0, 1)])
    return means.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("h0") == F.col("h1")).cast("double")).alias("agreement"))
