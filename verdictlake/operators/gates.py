"""Release gates: threshold predicates over report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the limits of a release
ECE_LIMIT = {"workhorse": 0.05, "premium": 0.03}
MOST_DROP, MOST_DELTA, LEAST_RECALL = 0.10, 0.01, 0.99
LEAST_CASES, FLOOR_SHARE, LEAST_LIFT, LEAST_CHANCE_SHARE, LEAST_SKILL = 5000, 0.5, 0.05, 0.25, 0.02


def check_gates(report: DataFrame, by: list[str], tier: str = "workhorse") -> DataFrame:
    """(by, gate, value, limit, passed, advisory) from rows with n, ece, adaptive_ece, accuracy, baseline, brier, marginal_brier and floor_p95."""
    limit = ECE_LIMIT[tier]
    lift = F.col("accuracy") - F.col("baseline")
    rules = [
        ("sample_size", F.col("n").cast("double"), LEAST_CASES, ">="),
        ("gate_is_testable", F.col("floor_p95"), FLOOR_SHARE * limit, "<="),
        ("accuracy_over_baseline", lift, LEAST_LIFT, ">="),
        ("accuracy_over_chance", lift / (1 - F.col("baseline")), LEAST_CHANCE_SHARE, ">="),
        ("brier_over_marginal", 1 - F.col("brier") / F.col("marginal_brier"), LEAST_SKILL, ">="),
        (f"{tier}_ece", F.col("ece"), limit, "<="),
        (f"{tier}_adaptive_ece", F.col("adaptive_ece"), limit, "<="),
    ]
    rows = [F.struct(F.lit(n).alias("gate"), v.alias("value"), F.lit(float(x)).alias("limit"), F.coalesce(v >= x if op == ">=" else v <= x, F.lit(False)).alias("passed"), F.lit(n == "gate_is_testable").alias("advisory")) for n, v, x, op in rules]
    return report.select(*by, F.explode(F.array(*rows)).alias("g")).select(*by, "g.*")


def verdict(gates: DataFrame, by: list[str]) -> DataFrame:
    """Whether all blocking gates pass, and the names of those that don't."""
    blocking = gates.where(~F.col("advisory"))
    return blocking.groupBy(*by).agg(F.bool_and("passed").alias("passed"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), ",").alias("blocked"))


def coverage_gate(coverage: DataFrame, target: float) -> DataFrame:
    """Coverage passes within three standard errors below its target."""
    floor = target - 3 * F.sqrt(F.lit(target * (1 - target)) / F.col("n"))
    return coverage.withColumns({"limit": floor, "passed": F.col("coverage") >= floor})


def _rows(report: DataFrame, by: list[str], rules: list[tuple[str, Column, float, str, bool]]) -> DataFrame:
    """A row for each rule (gate, value, limit, operator, advisory) whose value is known."""
    rows = [F.struct(F.lit(n).alias("gate"), v.cast("double").alias("value"), F.lit(float(x)).alias("limit"), (v >= x if op == ">=" else v <= x).alias("passed"), F.lit(advisory).alias("advisory")) for n, v, x, op, advisory in rules]
    return report.select(*by, F.explode(F.array(*rows)).alias("g")).select(*by, "g.*").where("value is not null")


def slice_gates(report: DataFrame, by: list[str], tier: str = "workhorse", require_per_question: bool = False) -> DataFrame:
    """Gates that pooled figures hide, from rows with worst_lift (the least lift of a question), worst_ece (the largest of a
    primitive), injection_drop, ece_delta (to another run of the suite) and recall; a null value has no gate.

    The per-question, per-primitive and injection gates are advisory until ``require_per_question``."""
    advisory = not require_per_question
    return _rows(report, by, [
        ("worst_question_over_baseline", F.col("worst_lift"), LEAST_LIFT, ">=", advisory),
        (f"worst_primitive_{tier}_ece", F.col("worst_ece"), ECE_LIMIT[tier], "<=", advisory),
        ("injection_robustness", F.col("injection_drop"), MOST_DROP, "<=", advisory),
        ("quantization_ece_delta", F.abs("ece_delta"), MOST_DELTA, "<=", False),
        ("recall", F.col("recall"), LEAST_RECALL, ">=", False),
    ])


def sweep_verdict(runs: DataFrame, by: list[str]) -> DataFrame:
    """runs (by, seed, passed, blocked: names, final_loss) to one row a configuration: certified if all seeds passed, the spread of the loss, what blocked.

    A run that passed and lists a blocking gate is an error: one of the two is wrong."""
    clash = F.col("passed") & (F.size("blocked") > 0)
    told = F.raise_error(F.concat(F.lit("passed with blocking failures: seed "), F.col("seed").cast("string")))
    sound = runs.where(F.when(clash, told.cast("boolean")).otherwise(F.lit(True)))
    out = sound.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seeds"), F.count_if("passed").alias("certified"), F.median("final_loss").alias("median_loss"), F.min("final_loss").alias("min_loss"), F.max("final_loss").alias("max_loss"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocked")))), ",").alias("blocked"),
    )
    return out.withColumns({"spread": F.col("max_loss") - F.col("min_loss"), "passed": F.col("certified") == F.col("seeds")})
