"""Answers joined to what was expected, and the reports made of them: suites, tasks, steps, ceilings and floors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import calibration as K
from . import compare as J
from . import faithful as H
from . import fits
from .evidence import token_prf


def score_join(predictions: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """predictions (key, probs), expected (key, y) to every prediction with y and correct; unlabelled ones have null in both."""
    joined = predictions.join(expected.select(*key, F.col("y").cast("int").alias("y")), key, "left")
    return joined.withColumn("correct", (V.argmax("probs") == F.col("y")).cast("double"))


def distinguishable(report: DataFrame, floor: DataFrame, by: list[str]) -> DataFrame:
    """``report`` (by, ece) with floor_p95 and whether its error stands out from chance; null where there is no floor."""
    joined = report.join(floor.select(*by, F.col("p95").alias("floor_p95")), by, "left")
    return joined.withColumn("distinguishable", F.col("ece") > F.col("floor_p95"))


def marginal_accuracy(scored: DataFrame, by: list[str], question: str) -> DataFrame:
    """(by, n, baseline): accuracy of each question's most frequent label, pooled over questions."""
    counts = scored.groupBy(*by, question, "y").agg(F.count(F.lit(1)).alias("n"))
    each = counts.groupBy(*by, question).agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return each.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("top") / F.sum("n")).alias("baseline"))


def summarize(cases: DataFrame, scored: DataFrame, by: list[str], question: str) -> DataFrame:
    """cases (by, latency, tokens), scored (by, question, probs, y or null) to one row a suite.

    Case sums and question sums are made apart, so that no case counts once for each of its questions."""
    pct = [F.expr(f"percentile_disc({q}) within group (order by latency)").alias(n) for q, n in ((0.5, "latency_p50"), (0.99, "latency_p99"))]
    per_case = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cases"), *pct, F.avg("tokens").alias("mean_tokens"))
    hit = (V.argmax("probs") == F.col("y")).cast("double")
    counts = scored.groupBy(*by, question, "y").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("right"))
    labelled = F.col("y").isNotNull()
    each = counts.groupBy(*by, question).agg(F.sum("n").alias("asked"), F.sum(F.when(labelled, F.col("n"))).alias("n"), F.sum("right").alias("right"), F.max(F.when(labelled, F.col("n"))).alias("top"))
    total = each.groupBy(*by).agg(
        F.sum("asked").alias("n_questions"), (F.sum("right") / F.sum("n")).alias("accuracy"), (F.sum("top") / F.sum("n")).alias("baseline"), F.min((F.col("right") - F.col("top")) / F.col("n")).alias("worst_lift")
    )
    return per_case.join(total, by)


def validation_loss(losses: DataFrame, epoch: str, case: str, loss: str) -> DataFrame:
    """(epoch, loss, kept): mean over cases of the mean over a case's questions; the first epoch of least loss is kept."""
    each = losses.groupBy(epoch, case).agg(F.avg(loss).alias("_l")).groupBy(epoch).agg(F.avg("_l").alias("loss"))
    best = each.agg(F.min_by(epoch, F.struct("loss", epoch)).alias("_best"))
    return each.crossJoin(F.broadcast(best)).select(epoch, "loss", (F.col(epoch) == F.col("_best")).alias("kept"))


def gap_closed(loss: Column, noise: float, k: int) -> Column:
    """Share of the way from chance among ``k`` labels to the loss that label noise leaves."""
    right, wrong = 1 - noise + noise / k, noise / k
    least = -(right * math.log(right) + ((k - 1) * wrong * math.log(wrong) if wrong else 0.0))
    return (math.log(k) - loss) / (math.log(k) - least)


def task_score(answers: DataFrame, by: list[str]) -> DataFrame:
    """answers (by, probs maybe unscaled or null, y or null) to n, failed, accuracy, chance, majority, ece, nll and brier.

    An answer without mass or without a label has failed; others are scaled to one first."""
    usable = F.coalesce((V.total("probs") > 0) & F.col("y").isNotNull(), F.lit(False))
    rows = answers.withColumn("_ok", usable)
    ok = K.with_confidence(rows.where("_ok").withColumn("probs", V.normalize("probs")))
    bins = ok.groupBy(*by, K.bin_of(F.col("conf")).alias("_bin"), "y").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("conf", "correct", "nll", "brier")], F.sum(1.0 / F.size("probs")).alias("chance"))
    label = bins.groupBy(*by, "y").agg(F.sum("n").alias("n")).groupBy(*by).agg((F.max("n") / F.sum("n")).alias("majority"))
    sums = bins.groupBy(*by, "_bin").agg(*[F.sum(c).alias(c) for c in ("n", "conf", "correct", "nll", "brier", "chance")])
    out = sums.groupBy(*by).agg(F.sum("n").alias("n"), *[(F.sum(c) / F.sum("n")).alias(a) for c, a in (("correct", "accuracy"), ("chance", "chance"), ("conf", "mean_confidence"), ("nll", "nll"), ("brier", "brier"))], (F.sum(F.abs(F.col("correct") - F.col("conf"))) / F.sum("n")).alias("ece"))
    failed = rows.groupBy(*by).agg(F.count_if(~F.col("_ok")).alias("failed"))
    return failed.join(out.join(label, by), by, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def step_score(operations: DataFrame, targets: DataFrame, case: str = "case_id") -> DataFrame:
    """operations (case, ops, probs, y), targets (case, op, probs, y) to one row for each true operation and one (null) for all.

    What is executed is the chosen operation on the best target of that operation's own head; an operation without a head
    needs none, so its target counts as certain."""
    chosen = operations.withColumns({"_op": F.element_at("ops", V.argmax("probs") + 1), "_true": F.element_at("ops", F.col("y") + 1), "_p": F.array_max("probs")})
    head = targets.select(case, "op", F.array_max("probs").alias("_tp"), (V.argmax("probs") == F.col("y")).alias("_hit"))
    own = head.select(case, F.col("op").alias("_true"), F.col("_hit").alias("target_ok"))
    done = head.select(case, F.col("op").alias("_op"), "_tp", F.col("_hit").alias("_done"))
    rows = chosen.join(own, [case, "_true"], "left").join(done, [case, "_op"], "left")
    rows = rows.select(
        F.col("_true").alias("operation"), (F.col("_op") == F.col("_true")).cast("double").alias("op_ok"), F.coalesce(F.col("target_ok").cast("double"), F.lit(0.0)).alias("target_ok"),
        ((F.col("_op") == F.col("_true")) & F.coalesce("_done", F.lit(True))).cast("double").alias("success"), F.round(F.col("_p") * F.coalesce("_tp", F.lit(1.0)), 9).alias("conf"),
    )
    # the executed action is right or not: a yes/no whose confidence is that of the likelier side
    top, right = F.greatest("conf", 1 - F.col("conf")), F.when(F.col("conf") > 0.5, F.col("success")).otherwise(1 - F.col("success"))
    both = rows.withColumns({"_bin": K.bin_of(F.round(top, 9)), "_gap": right - top}).select("*", F.explode(F.array(F.col("operation"), F.lit(None).cast("string"))).alias("slice"))
    bins = both.groupBy("slice", "_bin").agg(F.count(F.lit(1)).alias("n"), F.sum("_gap").alias("gap"), *[F.sum(c).alias(c) for c in ("op_ok", "target_ok", "success", "conf")])
    means = [(F.sum(c) / F.sum("n")).alias(a) for c, a in (("op_ok", "operation_accuracy"), ("target_ok", "target_accuracy"), ("success", "step_success"), ("conf", "mean_confidence"))]
    return bins.groupBy("slice").agg(F.sum("n").alias("n"), *means, (F.sum(F.abs("gap")) / F.sum("n")).alias("ece"))


def inspect_answers(scored: DataFrame, n: int, key: str = "case_id") -> DataFrame:
    """The first ``n`` cases with their two likeliest labels, the truth and whether it was hit."""
    ranked = F.array_sort(F.transform("probs", lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    rows = scored.orderBy(key).limit(n).withColumn("_r", ranked)
    label = lambda k: F.element_at("labels", F.col("_r")[k]["i"] + 1)
    return rows.select(key, label(0).alias("first"), (-F.col("_r")[0]["p"]).alias("p_first"), label(1).alias("second"), (-F.col("_r")[1]["p"]).alias("p_second"), F.element_at("labels", F.col("y") + 1).alias("truth"), (F.col("_r")[0]["i"] == F.col("y")).alias("hit"))


def steering(pairs: DataFrame, guardrail: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of clean (anchor) and injected (variant) answers, and guardrail answers (by, probs, y), to flip, drift, accuracies and detection."""
    seen = guardrail.groupBy(*by).agg(F.avg((V.argmax("probs") == F.col("y")).cast("double")).alias("guardrail_detection"))
    return J.pair_same(pairs, by).join(seen, by, "left")


def accuracy(outcomes: DataFrame, by: list[str]) -> DataFrame:
    return outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((V.argmax("probs") == F.col("y")).cast("double")).alias("accuracy"))


def ceiling_table(oracles: DataFrame, question: str = "question") -> DataFrame:
    """(question, y, naive, loo: labels) to marginal, naive and leave-one-out accuracy with lifts, by question and (null) their mean."""
    counts = oracles.groupBy(question, "y").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c) == F.col("y")).alias(c) for c in ("naive", "loo")])
    each = counts.groupBy(question).agg((F.max("n") / F.sum("n")).alias("marginal"), *[(F.sum(c) / F.sum("n")).alias(c) for c in ("naive", "loo")])
    both = each.select(F.explode(F.array(F.col(question), F.lit(None).cast("string"))).alias(question), "marginal", "naive", "loo")
    out = both.groupBy(question).agg(*[F.avg(c).alias(c) for c in ("marginal", "naive", "loo")])
    return out.withColumns({"naive_lift": F.col("naive") - F.col("marginal"), "loo_lift": F.col("loo") - F.col("marginal")})


def plausibility_suite(words: DataFrame, key: list[str], highlighters: dict[str, Column]) -> DataFrame:
    """words (key, gold) and named marks to one plausibility row for each highlighter, the floor of marking every word among them."""
    marks = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("predicted")) for n, c in {**highlighters, "every word": F.lit(True)}.items()])
    each = words.select(*key, "gold", F.explode(marks).alias("m")).select(*key, "gold", "m.*")
    return H.plausibility(token_prf(each, [*key, "name"]), each, [*key, "name"], ["name"])


def floor_suite(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Long metric rows (by, metric, value) of paired answers, to stand beside a model's."""
    wide = J.pair_same(pairs, by)
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in wide.columns if c not in by])).alias("m")).select(*by, "m.*")


def regate(fit: DataFrame, check: DataFrame, runs: list[str]) -> DataFrame:
    """Rows (runs, logits, probs, y) of many saved runs to n, accuracy, ece before and after a temperature refitted for each run on ``fit``."""
    temps = fits.fit_temperature(fit.select(*runs, "logits", "y"), runs).select(*runs, "t")
    warm = check.join(temps, runs).withColumn("probs", V.softmax("logits", F.col("t")))
    error = lambda df, name: K.ece(K.reliability_bins(df, runs, spine=False), runs).select(*runs, F.col("ece").alias(name))
    return accuracy(check, runs).join(error(check, "ece_before"), runs).join(error(warm, "ece_after"), runs).join(temps, runs)
