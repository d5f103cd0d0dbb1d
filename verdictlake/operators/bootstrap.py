"""Acceptance of a fitted calibrator by paired resampling, and the choice among calibrators.

A resample gives every row a Poisson(1) count drawn from its key, the form of the bootstrap
that needs no row index: a replicate is then a weighted sum, with partial sums on the map side.
One SHA-256 carries the draws of sixteen replicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import fits
from .calibration import BINS, bin_of, draws, refuse_teacher
from .splits import hash_holdout, one_per_case

POISSON = list(accumulate(math.exp(-1) / math.factorial(k) for k in range(8)))
ACCEPT, HARM = 0.80, 0.95


def mass_bin(points: DataFrame, by: list[str], conf: str, out: str, n_bins: int = BINS) -> DataFrame:
    """Add a bin of near-equal mass, cut on counts of confidences in thousandths: at most 1,001 rows a group."""
    cell = F.round(conf, 3)
    order = Window.partitionBy(*by).orderBy("_cell")
    counts = points.groupBy(*by, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(order) - F.col("_n")
    total = F.sum("_n").over(Window.partitionBy(*by))
    cuts = counts.select(*by, "_cell", F.floor(before * n_bins / total).cast("int").alias(out))
    return points.withColumn("_cell", cell).join(cuts, [*by, "_cell"]).drop("_cell")


def replicate_errors(points: DataFrame, by: list[str], key: str = "case_id", resamples: int = 200, salt: str = "boot") -> DataFrame:
    """points (by, key, y, conf_a, ok_a, conf_b, ok_b) to (by, rep, err_a, err_b, labels): the worse of ECE over equal width and over equal mass, for each arm."""
    binned = mass_bin(mass_bin(points, by, "conf_a", "ma"), by, "conf_b", "mb")
    binned = binned.withColumns({"wa": bin_of(F.col("conf_a")), "wb": bin_of(F.col("conf_b"))})
    margins = [(arm, scale) for arm in "ab" for scale in "wm"]
    rows = binned.select(*by, *[scale + arm for arm, scale in margins], "y", F.col(key).cast("string").alias("_key"), (F.col("ok_a") - F.col("conf_a")).alias("ga"), (F.col("ok_b") - F.col("conf_b")).alias("gb"))
    kinds = dict(binned.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "rep int, arm string, scale string, bin int, w double, gap double, lo double, hi double"])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            w = np.searchsorted(POISSON, draws(pdf["_key"].tolist(), resamples, salt), "right").astype(float)
            seen = w > 0
            y = pdf["y"].to_numpy(float)[:, None]
            low, high = np.where(seen, y, np.inf), np.where(seen, y, -np.inf)
            group = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(pdf), np.int64)
            # each margin is folded on its own: 15 bins a group, not their product with those of the other three
            for arm, scale in margins:
                bins = pdf[scale + arm].to_numpy(np.int64)
                order = np.lexsort((bins, group))
                starts = np.flatnonzero(np.concatenate([[True], (np.diff(group[order]) != 0) | (np.diff(bins[order]) != 0)]))
                first = order[starts]
                out = pdf[by].iloc[np.repeat(first, resamples)].reset_index(drop=True)
                out["rep"] = np.tile(np.arange(resamples, dtype=np.int32), len(starts))
                out["arm"], out["scale"], out["bin"] = arm, scale, np.repeat(bins[first].astype(np.int32), resamples)
                out["w"] = np.add.reduceat(w[order], starts, axis=0).ravel()
                out["gap"] = np.add.reduceat((w * pdf["g" + arm].to_numpy()[:, None])[order], starts, axis=0).ravel()
                out["lo"], out["hi"] = np.minimum.reduceat(low[order], starts, axis=0).ravel(), np.maximum.reduceat(high[order], starts, axis=0).ravel()
                yield out[out["w"] > 0]

    bins = rows.mapInPandas(fold, schema).groupBy(*by, "rep", "arm", "scale", "bin").agg(F.sum("w").alias("w"), F.sum("gap").alias("gap"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ece = bins.groupBy(*by, "rep", "arm", "scale").agg((F.sum(F.abs("gap")) / F.sum("w")).alias("e"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    arms = [F.max(F.when(F.col("arm") == a, F.round("e", 9))).alias(f"err_{a}") for a in "ab"]
    return ece.groupBy(*by, "rep").agg(*arms, (F.min("lo") < F.max("hi")).alias("labels"))


def help_is_real(points: DataFrame, by: list[str], key: str = "case_id", resamples: int = 200) -> DataFrame:
    """(by, counted, better, accepted): whether arm b has the lower error in enough resamples; those of one label don't count."""
    reps = replicate_errors(points, by, key, resamples).where("labels")
    out = reps.groupBy(*by).agg(F.count(F.lit(1)).alias("counted"), F.count_if(F.col("err_b") < F.col("err_a")).alias("better"))
    return out.withColumn("accepted", F.col("better") >= ACCEPT * F.col("counted"))


def harm_is_real(points: DataFrame, by: list[str], key: str = "case_id", resamples: int = 200) -> DataFrame:
    """(by, counted, worse, harmful): the mirror rule, kept for comparison."""
    reps = replicate_errors(points, by, key, resamples).where("labels")
    out = reps.groupBy(*by).agg(F.count(F.lit(1)).alias("counted"), F.count_if(F.col("err_b") > F.col("err_a")).alias("worse"))
    return out.withColumn("harmful", F.col("worse") >= HARM * F.col("counted"))


def arms(rows: DataFrame, keep: list[str], a: str, b: str) -> DataFrame:
    """(keep, y, conf_a, ok_a, conf_b, ok_b) from two columns of probabilities."""
    out = {}
    for name, p in (("a", a), ("b", b)):
        out |= {f"conf_{name}": F.round(F.array_max(p), 9), f"ok_{name}": (V.argmax(p) == F.col("y")).cast("double")}
    return rows.select(*keep, "y", *[c.alias(n) for n, c in out.items()])


def _error(points: DataFrame, by: list[str], arm: str, out: str) -> DataFrame:
    binned = mass_bin(points, by, f"conf_{arm}", "m").withColumn("w", bin_of(F.col(f"conf_{arm}")))
    each = binned.select(*by, (F.col(f"ok_{arm}") - F.col(f"conf_{arm}")).alias("gap"), F.explode(F.array(F.struct(F.lit("w").alias("scale"), F.col("w").alias("bin")), F.struct(F.lit("m").alias("scale"), F.col("m").alias("bin")))).alias("k")).select(*by, "gap", "k.*")
    bins = each.groupBy(*by, "scale", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("gap").alias("gap"))
    return bins.groupBy(*by, "scale").agg((F.sum(F.abs("gap")) / F.sum("n")).alias("e")).groupBy(*by).agg(F.max("e").alias(out))


def choose_calibrator(rows: DataFrame, by: list[str], key: str = "case_id", resamples: int = 200) -> DataFrame:
    """rows (by, key, logits, y) to (by, choice, t, base_error, temperature_error, isotonic_error).

    Both candidates are fitted on a keyed half and judged on the other; of those whose help is
    real the one with the lower error is chosen, or none."""
    halves = hash_holdout(rows, key, 0.5, "calibrate")
    fit, check = halves.where("not held_out"), halves.where("held_out").withColumn("base", V.softmax("logits"))
    temps = fits.fit_temperature(fit.select(*by, "logits", "y"), by)
    points = fit.withColumn("probs", V.softmax("logits")).select(*by, F.array_max("probs").alias("conf"), (V.argmax("probs") == F.col("y")).cast("double").alias("correct"))
    knots = fits.fit_isotonic(points, by)
    warm = check.join(temps.select(*by, "t"), by).withColumn("warm", V.softmax("logits", F.col("t")))
    mapped = fits.apply_isotonic(check.withColumn("probs", F.col("base")), knots, by).join(knots.select(*by).distinct(), by, "left_semi")
    a, b = arms(warm, [*by, key], "base", "warm"), arms(mapped, [*by, key], "base", "probs")
    tables = [
        temps.select(*by, "t"),
        _error(a, by, "a", "base_error"),
        _error(a, by, "b", "temperature_error"),
        help_is_real(a, by, key, resamples).select(*by, F.col("accepted").alias("temperature_ok")),
        _error(b, by, "b", "isotonic_error"),
        help_is_real(b, by, key, resamples).select(*by, F.col("accepted").alias("isotonic_ok")),
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, by, "left")
    iso, temp = F.coalesce("isotonic_ok", F.lit(False)), F.coalesce("temperature_ok", F.lit(False))
    choice = F.when(iso & (~temp | (F.col("isotonic_error") < F.col("temperature_error"))), "isotonic").when(temp, "temperature").otherwise("none")
    return out.select(*by, choice.alias("choice"), "t", "base_error", "temperature_error", "isotonic_error")


def fit_calibration(scored: DataFrame, resamples: int = 200) -> DataFrame:
    """scored (case_id, qid, kind, logits, y, from_teacher) to one choice for each kind: one answer of a case and kind, no teacher labels."""
    rows = one_per_case(refuse_teacher(scored, "a calibration fit"), "case_id", "kind", "qid")
    return choose_calibrator(rows, ["kind"], "case_id", resamples)


def binary_logits(logit: str) -> Column:
    """A yes/no logit as two logits, so that one temperature fit serves all kinds."""
    return F.array(F.lit(0.0), F.col(logit))


def logit_rows(scored: DataFrame) -> DataFrame:
    """Answers whose logits weren't kept: their log probabilities stand in."""
    return scored.withColumn("logits", F.transform("probs", lambda p: F.ln(F.greatest(p, F.lit(1e-12)))))


def refit_sources(points: DataFrame, kind: str, source: str) -> DataFrame:
    """points (kind, source, conf, correct) to n, accuracy, confidence and ECE of every (kind, source) and of a kind's pool (source null)."""
    bins = points.groupBy(kind, source, bin_of(F.col("conf")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("c"), F.sum("conf").alias("f"))
    both = bins.select(kind, F.explode(F.array(F.col(source), F.lit(None).cast("string"))).alias(source), "bin", "n", "c", "f")
    pooled = both.groupBy(kind, source, "bin").agg(*[F.sum(x).alias(x) for x in ("n", "c", "f")])
    return pooled.groupBy(kind, source).agg(F.sum("n").alias("n"), (F.sum("c") / F.sum("n")).alias("accuracy"), (F.sum("f") / F.sum("n")).alias("confidence"), (F.sum(F.abs(F.col("c") - F.col("f"))) / F.sum("n")).alias("ece"))
