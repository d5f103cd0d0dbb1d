"""Structured Streaming jobs over requests, predictions and late labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import vectors as V
from ..operators.calibration import bin_of, with_confidence


def rolling_bins(scored: DataFrame, ts: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Mergeable bin sums of each tumbling window; ``window_ece`` turns them into a score."""
    base = with_confidence(scored.withWatermark(ts, late) if scored.isStreaming else scored)
    return base.groupBy(F.window(ts, window).alias("w"), bin_of(F.col("conf")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct") - F.col("conf")).alias("gap"))


def window_ece(bins: DataFrame, limit: float = 0.05) -> DataFrame:
    out = bins.groupBy(F.col("w.start").alias("start")).agg(F.sum("n").alias("n"), (F.sum(F.abs("gap")) / F.sum("n")).alias("ece"))
    return out.withColumn("alert", F.col("ece") > limit)


def delayed_outcomes(predictions: DataFrame, labels: DataFrame, within: str = "7 days", late: str = "1 day") -> DataFrame:
    """Predictions (case_id, ts) left-joined to labels (case_id, label_ts) that come within an interval."""
    p, q = predictions.withWatermark("ts", late), labels.withWatermark("label_ts", late).withColumnRenamed("case_id", "_case")
    on = (F.col("case_id") == F.col("_case")) & (F.col("label_ts") >= F.col("ts")) & (F.col("label_ts") <= F.col("ts") + F.expr(f"interval {within}"))
    return p.join(q, on, "leftOuter").drop("_case")


def session_cost(requests: DataFrame, key: str, ts: str, tokens: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    base = requests.withWatermark(ts, late) if requests.isStreaming else requests
    return base.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens).alias("tokens")).select(key, F.col("s.start").alias("start"), "calls", "tokens")


def drop_repeats(requests: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    return requests.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def admit(requests: DataFrame, key: str, ts: str, rate: int, window: str = "1 minute") -> DataFrame:
    """Batch twin of window admission: the first ``rate`` requests of a key in each wall-clock window pass."""
    from pyspark.sql import Window

    start = F.window(ts, window)["start"]
    order = Window.partitionBy(key, "_w").orderBy(ts, "event_id")
    return requests.withColumn("_w", start).withColumn("admitted", F.row_number().over(order) <= rate).drop("_w")


def decide_stream(requests: DataFrame, temperatures: DataFrame) -> DataFrame:
    """Stateless decisions: temperature of the request's kind, softmax, top label and confidence."""
    joined = requests.join(F.broadcast(temperatures), "kind", "left")
    p = joined.withColumn("probs", V.softmax("logits", F.coalesce(F.col("t"), F.lit(1.0)))).drop("t")
    return p.withColumns({"selected": V.argmax("probs"), "confidence": V.choice_confidence("probs")})


def on_enough_rows(stream: DataFrame, kind: str, least: int, refit: Callable[[DataFrame], None]):
    """Start a query that calls ``refit`` on a micro-batch's kinds which have at least ``least`` rows so far."""

    def each(batch: DataFrame, _: int) -> None:
        ready = batch.where(F.col("count") >= least)
        if ready.limit(1).count():
            refit(ready)

    return stream.groupBy(kind).count().writeStream.outputMode("update").foreachBatch(each)


def admit_stream(requests: DataFrame, key: str, ts: str, event: str, rate: int, window_seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """Window admission on a stream: (key, event, ts, admitted, retry_after): the first ``rate`` requests of a key in each window
    pass, in the order of time within a micro-batch; others learn the seconds until the window ends.

    A key's state is the start of its latest window and a count; it leaves the store when the watermark, ``late`` behind the
    newest request of all, is past that window."""
    kinds = dict(requests.dtypes)
    schema = f"`{key}` {kinds[key]}, `{event}` {kinds[event]}, `{ts}` timestamp, admitted boolean, retry_after double"

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values([ts, event], kind="stable")
        start, count = state.get if state.exists else (-1, 0)
        seconds = rows[ts].astype("datetime64[us]").astype("int64") / 1e6
        admitted, wait = [], []
        for at in seconds:
            own = int(at // window_seconds) * window_seconds
            if own > start:
                start, count = own, 0
            ok = own == start and count < rate
            count += ok
            admitted.append(ok)
            wait.append(0.0 if ok else own + window_seconds - at)
        state.update((start, count))
        state.setTimeoutTimestamp(max((start + window_seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[[key, event, ts]].assign(admitted=admitted, retry_after=wait)

    timed = requests.select(key, event, ts).withWatermark(ts, late)
    return timed.groupBy(key).applyInPandasWithState(step, schema, "start long, count long", "append", GroupStateTimeout.EventTimeTimeout)


def late_rows(query) -> int:
    """Rows that a running query has dropped as later than its watermark."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])
