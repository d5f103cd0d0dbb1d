"""Fitted parameters: temperatures, isotonic knots, conformal thresholds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .calibration import cell_of, distinct_points, matched

LOW, HIGH = 0.05, 20.0
ROUNDS, GRID = 3, 65
ISOTONIC_LEAST = 400
WORST = -math.log(1e-12)
EDGE = 1e-6


def _losses(rows: DataFrame, by: list[str], width: int) -> DataFrame:
    """rows (by, logits, y, ts: ``width`` candidates, the same within a group) to (by, ts, n, sums): log losses summed over a group.

    A batch's rows are folded by group in one pass over their logits, so a row is never repeated for its candidates; what is
    shuffled has a row for each batch and group."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "ts array<double>, n long, sums array<double>"])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            group = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(pdf), np.int64)
            order = group.argsort(kind="stable")
            pdf, group = pdf.iloc[order], group[order]
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.array([len(z) for z in pdf["logits"]])
            z = np.full((len(pdf), size.max()), -np.inf)
            z[np.arange(z.shape[1]) < size[:, None]] = np.concatenate(pdf["logits"].to_numpy())
            z -= z.max(1, keepdims=True)
            own = z[np.arange(len(z)), pdf["y"].to_numpy(np.int64)]
            ts = np.stack(pdf["ts"].to_numpy()[starts])
            sums = np.zeros((len(starts), width))
            step = max(1, 2_000_000 // (width * z.shape[1]))
            for at in range(0, len(z), step):
                g = group[at : at + step]
                t = ts[g]
                loss = np.minimum(np.log(np.exp(z[at : at + step, None, :] / t[:, :, None]).sum(2)) - own[at : at + step, None] / t, WORST)
                cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                sums[g[cut]] += np.add.reduceat(loss, cut, axis=0)
            out = pdf[by].iloc[starts].reset_index(drop=True)
            out["ts"], out["n"], out["sums"] = list(ts), np.diff(np.append(starts, len(pdf))), list(sums)
            yield out

    folded = rows.select(*by, "logits", "y", "ts").mapInPandas(fold, schema)
    added = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)])
    return folded.groupBy(*by).agg(F.first("ts").alias("ts"), F.sum("n").alias("n"), added.alias("sums"))


def temperature_losses(rows: DataFrame, by: list[str], temperatures: list[float]) -> DataFrame:
    """(by, t, nll): mean log loss of ``rows`` (logits, y) at every candidate temperature."""
    tried = rows.withColumn("ts", F.array(*[F.lit(float(t)) for t in temperatures]))
    each = F.explode(F.arrays_zip(F.col("ts").alias("t"), F.col("sums").alias("s"))).alias("x")
    return _losses(tried, by, len(temperatures)).select(*by, "n", each).select(*by, "x.t", (F.col("x.s") / F.col("n")).alias("nll"))


def fit_temperature(rows: DataFrame, by: list[str], rounds: int = ROUNDS, grid: int = GRID) -> DataFrame:
    """(by, t, nll, at_bound): the temperature of least mean log loss, the lowest on ties, of every group in one plan.

    Every round tries an even grid over each group's interval and narrows it to the best point's neighbours. A group's
    interval is a row of a table that its rows are joined to, whatever the number of groups; nothing passes through the driver."""
    interval = {"lo": F.lit(LOW), "hi": F.lit(HIGH)}
    base, found = rows.select(*by, "logits", "y"), None
    step = (F.col("hi") - F.col("lo")) / (grid - 1)
    for _ in range(rounds):
        if found is None:
            tries = base.withColumns(interval)
        else:
            tries = base.alias("a").join(found.select(*by, "lo", "hi").alias("b"), matched(by, "a", "b")).select("a.*", "lo", "hi")
        ts = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.col("lo") + i * step)
        sums = _losses(tries.withColumn("ts", ts), by, grid)
        at = F.array_position("sums", F.array_min("sums")).cast("int")
        best = sums.select(*by, F.element_at("ts", at).alias("t"), (F.array_min("sums") / F.col("n")).alias("nll"), ((F.element_at("ts", -1) - F.element_at("ts", 1)) / (grid - 1)).alias("step"))
        found = best.select(*by, "t", "nll", F.greatest(F.lit(LOW), F.col("t") - F.col("step")).alias("lo"), F.least(F.lit(HIGH), F.col("t") + F.col("step")).alias("hi"))
    return found.select(*by, "t", "nll", ((F.col("t") <= LOW + 0.01) | (F.col("t") >= HIGH - 0.01)).alias("at_bound"))


def fit_binary_temperature(rows: DataFrame, by: list[str], logit: str = "logit", y: str = "y") -> DataFrame:
    """rows (by, logit of yes, y of 0 or 1) to (by, t, nll, at_bound): the temperature under which sigmoid(logit / t) fits best."""
    return fit_temperature(rows.select(*by, F.array(F.lit(0.0), F.col(logit)).alias("logits"), F.col(y).cast("int").alias("y")), by)


def _pooled(blocks: DataFrame, by: list[str], part: Column) -> DataFrame:
    """Blocks (by, cell, x, s, n) of each (by, part) pooled to blocks whose means rise.

    A task goes through its parts in order and keeps the blocks of one part at a time."""
    key = [*by, "_part"]

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is None:
                rows = held
            else:
                # what was pooled before may be null by its schema, so a batch's columns that may not be are let be too
                free = pa.schema([f.with_nullable(True) for f in batch.schema])
                rows = pa.Table.from_batches([pa.RecordBatch.from_arrays(batch.columns, schema=free)])
                rows = rows if held is None else pa.concat_tables([held, rows])
            if rows is None or not rows.num_rows:
                continue
            fresh = np.zeros(rows.num_rows, bool)
            fresh[0] = True
            for c in key:
                one, two = rows.column(c).slice(0, rows.num_rows - 1), rows.column(c).slice(1)
                differ = pc.or_(pc.fill_null(pc.not_equal(one, two), False), pc.xor(pc.is_null(one), pc.is_null(two)))
                fresh[1:] |= differ.to_numpy(zero_copy_only=False) if isinstance(differ, pa.Array) else differ.combine_chunks().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(fresh).tolist()
            points = list(zip(*(rows.column(c).to_pylist() for c in "xsn")))
            kept, source = [], []
            for i, j in zip(starts, [*starts[1:], len(points)]):
                last = len(kept)
                kept += pool_violators(points[i:j])
                source += [i] * (len(kept) - last)
            out = rows.take(pa.array(source))
            for k, c in enumerate("xsn"):
                out = out.set_column(out.schema.get_field_index(c), c, pa.array([block[k] for block in kept], pa.float64()))
            # the last part may go on in the next batch
            done = len(kept) if batch is None else last
            held = out.slice(done)
            yield from out.slice(0, done).drop_columns("_part").combine_chunks().to_batches()

    dealt = blocks.withColumn("_part", part).repartition(*key).sortWithinPartitions(*key, "x")
    return dealt.mapInArrow(pool, blocks.schema)


def fit_isotonic(points: DataFrame, by: list[str], x: str = "conf", y: str = "correct") -> DataFrame:
    """(by, low, right, value): the non-decreasing least-squares step function, ``value`` on (low, right], for groups of enough rows.

    Pooling of violators is associative: blocks that a range of confidences is pooled to can be pooled with those of the
    next. So distinct confidences are pooled by cell, cells by sixty-fours and those by group, and a task sees what is left of a
    range. A group's first ``low`` is null and its last ``right`` counts for all above."""
    pooled = distinct_points(points, by, x, y).select(*by, "cell", "x", F.col("s").cast("double").alias("s"), F.col("n").cast("double").alias("n"))
    enough = pooled.groupBy(*by).agg(F.sum("n").alias("_w")).where(F.col("_w") >= ISOTONIC_LEAST)
    blocks = pooled.alias("a").join(enough.alias("b"), matched(by, "a", "b")).select("a.*")
    for part in (F.col("cell"), F.floor(F.col("cell") / 64).cast("int"), F.lit(0)):
        blocks = _pooled(blocks, by, part)
    # what a group is pooled to in the end has been in one task, so its order can be too
    low = F.lag("x").over(Window.partitionBy(*by).orderBy("x"))
    return blocks.select(*by, low.alias("low"), F.col("x").alias("right"), (F.col("s") / F.col("n")).alias("value"))


def pool_violators(points: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """Blocks of (x, sum, weight) in order merged while their means don't rise."""
    stack: list[tuple[float, float, float]] = []
    for x, s, w in points:
        while stack and stack[-1][1] * w >= s * stack[-1][2]:
            _, s0, w0 = stack.pop()
            s, w = s0 + s, w0 + w
        stack.append((x, s, w))
    return stack


def apply_isotonic(scored: DataFrame, knots: DataFrame, by: list[str]) -> DataFrame:
    """``scored`` with its top probability mapped through the knots and the others rescaled; groups without knots stay as they are.

    A step is dealt to the cells it spans, so that a row meets the steps of its own cell alone, and a large group's rows
    spread over its cells."""
    top = F.array_max("probs")
    last = F.lead("right").over(Window.partitionBy(*by).orderBy("right")).isNull()
    open_end = knots.select(*by, F.coalesce("low", F.lit(-1.0)).alias("_low"), F.when(last, F.lit(2.0)).otherwise(F.col("right")).alias("_right"), F.col("value").alias("_value"))
    spans = F.sequence(cell_of(F.greatest(F.col("_low"), F.lit(0.0))), cell_of(F.least(F.col("_right"), F.lit(1.0))))
    steps = open_end.select(*by, "_low", "_right", "_value", F.explode(spans).alias("_cell"))
    rows = scored.withColumns({"_top": F.round(top, 9), "_cell": cell_of(F.round(top, 9))})
    here = matched(by, "a", "b") & (F.col("a._cell") == F.col("b._cell")) & (F.col("a._top") > F.col("b._low")) & (F.col("a._top") <= F.col("b._right"))
    joined = rows.alias("a").join(steps.alias("b"), here, "left").select("a.*", "b._value")
    target = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), F.col("_value")))
    scale = (1 - target) / F.greatest(1 - top, F.lit(1e-12))
    mapped = F.transform("probs", lambda p, i: F.when(i == V.argmax("probs"), target).otherwise(p * scale))
    return joined.withColumn("probs", F.when(F.col("_value").isNull(), F.col("probs")).otherwise(mapped)).select(*scored.columns)


def conformal_score(method: str = "lac"):
    truth = F.element_at("probs", F.col("y").cast("int") + 1)
    if method == "lac":
        return F.round(1 - truth, 9)
    # mass of all that rank before the label, and its own
    above = F.transform("probs", lambda p, i: F.when((p > truth) | ((p == truth) & (i <= F.col("y"))), p).otherwise(0.0))
    return F.round(V.total(above), 9)


def fit_conformal(scored: DataFrame, by: list[str], alpha: float = 0.1, method: str = "lac") -> DataFrame:
    """(by, n, threshold): the score of rank min(ceil((n + 1)(1 - alpha)), n).

    The rank is found on counts of distinct scores, not on rows."""
    counts = scored.groupBy(*by, conformal_score(method).alias("score")).count()
    order = Window.partitionBy(*by).orderBy("score")
    ranked = counts.withColumns({"cum": F.sum("count").over(order), "n": F.sum("count").over(Window.partitionBy(*by))})
    rank = F.least(F.ceil((F.col("n") + 1) * (1.0 - alpha)), F.col("n"))
    return ranked.where((F.col("cum") >= rank) & (F.col("n") >= math.ceil(1 / alpha) - 1)).groupBy(*by).agg(F.first("n").alias("n"), F.min("score").alias("threshold"))


def conformal_coverage(scored: DataFrame, thresholds: DataFrame, by: list[str], method: str = "lac") -> DataFrame:
    """(by, n, coverage, mean_size) of the prediction sets."""
    t = thresholds.select(*by, "threshold")
    joined = scored.join(t, by) if by else scored.crossJoin(t)
    sets = joined.withColumn("set", (V.lac_set if method == "lac" else V.aps_set)("probs", F.col("threshold")))
    return sets.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_contains("set", F.col("y").cast("int")).cast("double")).alias("coverage"), F.avg(F.size("set")).alias("mean_size"))
