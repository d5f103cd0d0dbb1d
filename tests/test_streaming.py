"""Streams give the rows of their batch twins."""

import os
from datetime import UTC, datetime

from pyspark.sql import functions as F

from verdictlake.streaming import monitor

SCHEMA = "case_id long, ts timestamp, probs array<double>, y int"


def test_rolling_bins_on_a_stream(spark, tmp_path):
    rows = spark.range(600).select(F.col("id").alias("case_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 600).alias("ts"), F.array(F.lit(0.8), F.lit(0.2)).alias("probs"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = monitor.rolling_bins(stream).writeStream.outputMode("complete").format("memory").queryName("rolling").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.start, r.n, round(r.ece, 9)) for r in monitor.window_ece(spark.table("rolling")).collect()}
    want = {(r.start, r.n, round(r.ece, 9)) for r in monitor.window_ece(monitor.rolling_bins(spark.read.parquet(f"{tmp_path}/in"))).collect()}
    assert got == want and len(got) >= 4


def test_late_labels_join_within_their_interval(spark):
    p = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "case_id long, t long").select("case_id", F.timestamp_seconds("t").alias("ts"))
    q = spark.createDataFrame([(1, 86_400), (2, 30 * 86_400)], "case_id long, t long").select("case_id", F.timestamp_seconds("t").alias("label_ts"))
    got = {r.case_id: r.label_ts is not None for r in monitor.delayed_outcomes(p, q).collect()}
    assert got == {1: True, 2: False, 3: False}


def run(stream, tmp_path, name, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
    query.processAllAvailable()
    return query


def source(spark, tmp_path, name, schema, batches):
    """One file a micro-batch, in the order given."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/part={k}")
    files = sorted((tmp_path / name).glob("part=*/*.parquet"))
    for k, f in enumerate(files):
        at = tmp_path / f"{name}-flat"
        at.mkdir(exist_ok=True)
        f.rename(at / f"{k:03d}.parquet")
        os.utime(at / f"{k:03d}.parquet", (1_700_000_000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}-flat")


def test_admission_keeps_its_count_between_batches(spark, tmp_path):
    at = lambda s: datetime.fromtimestamp(1_700_000_040 + s, UTC)
    batches = [[("a", 1, at(0)), ("a", 2, at(1)), ("b", 3, at(2))], [("a", 4, at(3)), ("a", 5, at(61))], [("b", 6, at(4)), ("b", 7, at(5)), ("a", 8, at(62))]]
    stream = source(spark, tmp_path, "in", "key string, event_id long, ts timestamp", batches)
    query = run(monitor.admit_stream(stream, "key", "ts", "event_id", 2, 60), tmp_path, "admitted")
    query.stop()
    got = {r.event_id: (r.admitted, r.retry_after) for r in spark.table("admitted").collect()}
    assert {k for k, v in got.items() if not v[0]} == {4, 7} and got[4] == (False, 57.0) and got[7] == (False, 55.0)
    rows = spark.createDataFrame([r for b in batches for r in b], "key string, event_id long, ts timestamp")
    assert {r.event_id: r.admitted for r in monitor.admit(rows, "key", "ts", 2).collect()} == {k: v[0] for k, v in got.items()}


def test_decisions_on_a_stream(spark, tmp_path):
    stream = source(spark, tmp_path, "in", "kind string, logits array<double>", [[("choice", [0.0, 2.0])], [("score", [1.0, 0.0, 0.0])]])
    temps = spark.createDataFrame([("choice", 2.0)], "kind string, t double")
    run(monitor.decide_stream(stream, temps), tmp_path, "decided").stop()
    got = {r.kind: (r.selected, round(max(r.probs), 6)) for r in spark.table("decided").collect()}
    assert got == {"choice": (1, 0.731059), "score": (0, 0.576117)}


def test_late_labels_join_on_streams(spark, tmp_path):
    day = lambda d: datetime.fromtimestamp(86_400 * d, UTC)
    p = source(spark, tmp_path, "p", "case_id long, ts timestamp", [[(1, day(10)), (2, day(10)), (3, day(10))], [(4, day(40))], [(5, day(60))]])
    q = source(spark, tmp_path, "q", "case_id long, label_ts timestamp", [[(1, day(12)), (2, day(30))], [(4, day(41))], [(5, day(61))]])
    run(monitor.delayed_outcomes(p, q), tmp_path, "joined").stop()
    got = {r.case_id: r.label_ts is not None for r in spark.table("joined").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True}


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, UTC)
    stream = source(spark, tmp_path, "in", "fingerprint string, ts timestamp", [[("a", at(0)), ("b", at(1)), ("a", at(2))], [("a", at(60)), ("c", at(20_000))], [("c", at(20_010))], [("d", at(3))]])
    query = run(monitor.drop_repeats(stream, "fingerprint", "ts"), tmp_path, "once")
    late = monitor.late_rows(query)
    query.stop()
    assert sorted(r.fingerprint for r in spark.table("once").collect()) == ["a", "b", "c"] and late == 1


def test_refit_waits_for_enough_rows(spark, tmp_path):
    seen = []
    stream = source(spark, tmp_path, "in", "kind string, y int", [[("a", 0)] * 3, [("a", 1)] * 3 + [("b", 0)], [("b", 0)]])
    query = monitor.on_enough_rows(stream, "kind", 5, lambda ready: seen.append({r.kind: r["count"] for r in ready.collect()})).option("checkpointLocation", f"{tmp_path}/refit").start()
    query.processAllAvailable()
    query.stop()
    assert seen == [{"a": 6}]
