"""Calibration statistics. ``scored`` has probs (array of double) and y (int) besides keys.

Every statistic starts from mergeable sums per bin, so a report is one grouped
aggregation with partial sums on the map side, whatever the number of slices.
Confidences are rounded to nine decimals before they are binned or compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

BINS = 15


def with_confidence(scored: DataFrame) -> DataFrame:
    """Add conf (top probability), correct and the two proper scores."""
    return scored.withColumns(
        {
            "conf": F.round(F.array_max("probs"), 9),
            "correct": (V.argmax("probs") == F.col("y")).cast("double"),
            "nll": V.log_loss("probs", "y"),
            "brier": V.brier("probs", "y"),
        }
    )


def check_scored(scored: DataFrame) -> DataFrame:
    """Rows whose probabilities don't sum to one within 1e-6 or whose label is out of range."""
    return scored.where((F.abs(V.total("probs") - 1) > 1e-6) | (F.col("y") < 0) | (F.col("y") >= F.size("probs")))


def bin_of(conf: Column, n_bins: int = BINS) -> Column:
    return F.least(F.floor(conf / (1.0 / n_bins)), F.lit(n_bins - 1)).cast("int")


def reliability_bins(scored: DataFrame, by: list[str], n_bins: int = BINS, spine: bool = True) -> DataFrame:
    """(by, bin, n, conf, acc); empty bins are zeros unless ``spine`` is off."""
    got = with_confidence(scored).groupBy(*by, bin_of(F.col("conf"), n_bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("conf"), F.avg("correct").alias("acc"))
    if not spine:
        return got
    every = (got.select(*by).distinct() if by else got.sparkSession.range(1).select()).select(*by, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return every.join(got, [*by, "bin"], "left").select(*by, "bin", *[F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (("n", "long"), ("conf", "double"), ("acc", "double"))])


CELLS = 4096


def cell_of(conf: Column) -> Column:
    """Cells of equal width: as confidences have nine decimals, a cell has at most 10**9 / CELLS distinct ones, whatever a group's size."""
    return F.floor(conf * CELLS).cast("int")


def distinct_points(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, cell, x, n, s): how often each distinct ``x`` (nine decimals) occurs and the sum of ``y``."""
    return points.groupBy(*by, F.round(x, 9).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s")).select(*by, cell_of(F.col("x")).alias("cell"), "x", "n", "s")


def matched(by: list[str], left: str, right: str) -> Column:
    """Whether two aliased tables agree in ``by``, null agreeing with null."""
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def equal_mass_bins(scored: DataFrame, by: list[str], n_bins: int = BINS) -> DataFrame:
    """(by, bin, n, conf, acc) over groups of near-equal size that never part equal confidences.

    A bin closes at the first distinct confidence at or past its share of the rows. With c(i) shares reached at the i-th
    distinct confidence, k(i) = min(k(i - 1) + 1, c(i)) bins are closed there, so k(i) = i + the least of c(j) - j up to i:
    running sums and a running minimum, which cells of confidences compute on their own once they know the totals of the
    cells before them. No task sees more of a group than a cell, or than a row for each of its cells."""
    points = distinct_points(with_confidence(scored), by, "conf", "correct")
    whole, inside = Window.partitionBy(*by).orderBy("cell"), Window.partitionBy(*by, "cell").orderBy("x")
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    sizes = points.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("_p"), F.sum("n").alias("_r"))
    offsets = sizes.select(*by, "cell", F.coalesce(F.sum("_p").over(earlier), F.lit(0)).alias("_p"), F.coalesce(F.sum("_r").over(earlier), F.lit(0)).alias("_r"), F.sum("_r").over(Window.partitionBy(*by)).alias("_total"))
    placed = points.alias("a").join(offsets.alias("b"), matched(by, "a", "b") & (F.col("a.cell") == F.col("b.cell"))).select("a.*", "_p", "_r", "_total")
    seen = F.col("_r") + F.sum("n").over(inside)
    at = F.col("_p") + F.row_number().over(inside)
    bins = F.least(F.lit(n_bins), F.col("_total"))
    shares = F.size(F.filter(F.sequence(F.lit(1), bins), lambda j: F.bround(j * (F.col("_total") / bins)) <= F.col("_seen")))
    ranked = placed.withColumns({"_seen": seen, "_at": at}).withColumn("_d", shares - F.col("_at"))
    least = ranked.groupBy(*by, "cell").agg(F.min("_d").alias("_d"))
    carried = least.select(*by, "cell", F.coalesce(F.min("_d").over(earlier), F.lit(0)).alias("_carried"))
    before = F.least(F.lit(0), F.col("_carried"), F.min("_d").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    closed = F.col("_at") - 1 + before
    cut = ranked.alias("a").join(carried.alias("b"), matched(by, "a", "b") & (F.col("a.cell") == F.col("b.cell"))).select("a.*", "_carried").select(*by, F.least(closed, bins - 1).cast("int").alias("bin"), "n", "x", "s")
    return cut.groupBy(*by, "bin").agg(F.sum("n").alias("n"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("conf"), (F.sum("s") / F.sum("n")).alias("acc"))


def ece(bins: DataFrame, by: list[str], name: str = "ece") -> DataFrame:
    gap = F.abs(F.col("acc") - F.col("conf"))
    return bins.groupBy(*by).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias(name), F.max(F.when(F.col("n") > 0, gap)).alias(name.replace("ece", "mce")))


def calibration_report(scored: DataFrame, by: list[str]) -> DataFrame:
    """n, ece, mce, adaptive_ece, brier, nll, accuracy, confidence and overconfidence of each slice."""
    base = with_confidence(scored)
    bins = base.groupBy(*by, bin_of(F.col("conf")).alias("bin")).agg(*[F.sum(c).alias(c) for c in ("conf", "correct", "nll", "brier")], F.count(F.lit(1)).alias("n"))
    gap = F.abs(F.col("correct") - F.col("conf"))
    out = bins.groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum(gap) / F.sum("n")).alias("ece"), F.max(gap / F.col("n")).alias("mce"), *[(F.sum(c) / F.sum("n")).alias(a) for c, a in (("brier", "brier"), ("nll", "nll"), ("correct", "accuracy"), ("conf", "confidence"))]
    )
    adaptive = ece(equal_mass_bins(scored, by), by, "adaptive_ece").drop("adaptive_mce")
    joined = out.alias("a").join(adaptive.alias("b"), matched(by, "a", "b")).select("a.*", "adaptive_ece")
    return joined.withColumn("overconfidence", F.col("confidence") - F.col("accuracy"))


def slice_reports(scored: DataFrame) -> DataFrame:
    """The report's sums over domain, kind and everything at once, by grouping sets; ``slice`` has a prefix."""
    base = with_confidence(scored).withColumn("bin", bin_of(F.col("conf")))
    base = base.select(F.explode(F.array(F.concat(F.lit("domain:"), F.col("domain")), F.concat(F.lit("kind:"), F.col("kind")), F.lit("all"))).alias("slice"), "bin", "conf", "correct", "nll", "brier")
    bins = base.groupBy("slice", "bin").agg(*[F.sum(c).alias(c) for c in ("conf", "correct", "nll", "brier")], F.count(F.lit(1)).alias("n"))
    gap = F.abs(F.col("correct") - F.col("conf"))
    return bins.groupBy("slice").agg(F.sum("n").alias("n"), (F.sum(gap) / F.sum("n")).alias("ece"), *[(F.sum(c) / F.sum("n")).alias(a) for c, a in (("brier", "brier"), ("nll", "nll"), ("correct", "accuracy"))])


def draws(keys: list, resamples: int, salt: str) -> np.ndarray:
    """Keys times resamples of uniforms of sixteen bits; one SHA-256 carries the draws of sixteen resamples."""
    blocks = [f"{salt}|{b}|" for b in range(math.ceil(resamples / 16))]
    raw = b"".join(hashlib.sha256(f"{b}{k}".encode()).digest() for k in keys for b in blocks)
    return np.frombuffer(raw, ">u2").reshape(len(keys), -1)[:, :resamples] / 65536.0


def fold_draws(points: DataFrame, groups: list[str], sums: str, fold: Callable[[pd.DataFrame, np.ndarray, np.ndarray], dict[str, np.ndarray]], key: str, resamples: int, salt: str) -> DataFrame:
    """(groups, rep, sums): partial sums of a batch's rows for each group and resample, which an aggregation merges.

    ``fold`` turns rows sorted by group, their draws and the groups' first rows into groups times resamples of each column
    of ``sums``, so that rows times resamples exist only within a batch."""
    kinds = dict(points.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in groups), "rep int", sums])
    names = [c.split()[0] for c in sums.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            order = pdf.groupby(groups, dropna=False, sort=False).ngroup().to_numpy().argsort(kind="stable")
            pdf = pdf.iloc[order].reset_index(drop=True)
            number = pdf.groupby(groups, dropna=False, sort=False).ngroup().to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            folded = fold(pdf, draws(pdf[key].tolist(), resamples, salt), starts)
            out = pdf[groups].iloc[np.repeat(starts, resamples)].reset_index(drop=True)
            out["rep"] = np.tile(np.arange(resamples, dtype=np.int32), len(starts))
            for name in names:
                out[name] = folded[name].ravel()
            yield out

    return points.mapInPandas(run, schema)


def noise_floor(scored: DataFrame, by: list[str], key: str = "case_id", trials: int = 200) -> DataFrame:
    """(by, n, mean, p95): the ECE of a calibrated model on these confidences.

    A label drawn from the probabilities hits the top with probability conf, so a trial needs conf and a keyed draw alone;
    the trials of a batch of rows are folded into bins before anything is shuffled."""
    conf = F.round(F.array_max("probs"), 9)
    points = scored.select(*by, F.col(key).cast("string").alias("_key"), conf.alias("conf")).withColumn("bin", bin_of(F.col("conf")))

    def fold(pdf: pd.DataFrame, u: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        c = pdf["conf"].to_numpy()[:, None]
        size = np.diff(np.append(starts, len(pdf)))
        return {"n": np.repeat(size[:, None], trials, 1), "gap": np.add.reduceat((u < c) - c, starts, axis=0)}

    bins = fold_draws(points, [*by, "bin"], "n long, gap double", fold, "_key", trials, "floor").groupBy(*by, F.col("rep").alias("trial"), "bin").agg(F.sum("n").alias("n"), F.sum("gap").alias("gap"))
    each = bins.groupBy(*by, "trial").agg((F.sum(F.abs("gap")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
    rank = round(0.95 * (trials - 1))
    return each.groupBy(*by).agg(F.max("n").alias("n"), F.avg("ece").alias("mean"), F.element_at(F.array_sort(F.collect_list("ece")), rank + 1).alias("p95"))


def per_question(scored: DataFrame, by: list[str]) -> DataFrame:
    """n, accuracy, accuracy of the most frequent label, and lift."""
    base = with_confidence(scored)
    counts = base.groupBy(*by, "y").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("right"))
    out = counts.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("accuracy"), (F.max("n") / F.sum("n")).alias("baseline"))
    return out.withColumn("lift", F.col("accuracy") - F.col("baseline"))


def baseline_accuracy(train: DataFrame, evaluation: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy on ``evaluation`` of the most frequent training label; the lowest on ties."""
    counts = train.groupBy(*by, "y").count()
    mode = counts.groupBy(*by).agg(F.max_by("y", F.struct("count", -F.col("y"))).alias("mode"))
    return evaluation.join(F.broadcast(mode), by, "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce((F.col("y") == F.col("mode")).cast("double"), F.lit(0.0))).alias("accuracy"))


def marginal_scores(train: DataFrame, evaluation: DataFrame, by: list[str]) -> DataFrame:
    """Brier and log loss on ``evaluation`` of the training labels' shares, each count plus one."""
    width = evaluation.groupBy(*by).agg(F.max(F.size("probs")).alias("k"))
    counts = train.groupBy(*by, "y").count().groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("y", "count"))).alias("m"))
    shares = width.join(counts, by, "left").select(*by, V.normalize(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)) + 1.0)).alias("share"))
    return evaluation.join(F.broadcast(shares), by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(V.brier("share", "y")).alias("brier"), F.avg(V.log_loss("share", "y")).alias("nll"))


def ten_bin_ece(scored: DataFrame, by: list[str], edges: str = "right") -> DataFrame:
    """ECE over ten bins whose edges belong to the left bin (``right``: (lo, hi]) or to the right one (``left``)."""
    base = with_confidence(scored)
    b = F.greatest(F.ceil(F.col("conf") * 10) - 1, F.lit(0)) if edges == "right" else F.least(F.floor(F.col("conf") * 10), F.lit(9))
    bins = base.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct") - F.col("conf")).alias("gap"))
    return bins.groupBy(*by).agg((F.sum(F.abs("gap")) / F.sum("n")).alias("ece"))


def refuse_teacher(scored: DataFrame, doing: str) -> DataFrame:
    """``scored``, with an error at run time if a row's label came from a teacher."""
    told = F.raise_error(F.concat(F.lit(f"teacher labels can't be used for {doing}: case "), F.col("case_id").cast("string")))
    return scored.where(F.when(F.col("from_teacher"), told.cast("boolean")).otherwise(F.lit(True)))


def daily_sketches(scored: DataFrame, by: list[str], day: str, case: str = "case_id") -> DataFrame:
    """(by, day, cases, confs): mergeable sketches of a day's distinct cases (HLL) and confidences (KLL), to be stored a day at a time."""
    rows = scored.select(*by, day, case, F.array_max("probs").alias("_conf"))
    return rows.groupBy(*by, day).agg(F.hll_sketch_agg(case, F.lit(14)).alias("cases"), F.kll_sketch_agg_double("_conf", F.lit(400)).alias("confs"))


def approximate_report(sketches: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """(by, n, cases, quantiles) merged from stored sketches of any days, without their rows.

    With these sizes the count of cases is within about 3 % and the rank of a quantile within about 1 %."""
    out = sketches.groupBy(*by).agg(F.hll_union_agg("cases").alias("_cases"), F.kll_merge_agg_double("confs").alias("_confs"))
    values = F.array(*[F.kll_sketch_get_quantile_double("_confs", F.lit(q)) for q in quantiles])
    return out.select(*by, F.kll_sketch_get_n_double("_confs").alias("n"), F.hll_sketch_estimate("_cases").alias("cases"), values.alias("quantiles"))
