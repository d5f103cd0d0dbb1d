"""Statistics on tables whose answers are known by hand."""

import pytest
import numpy as np
from pyspark.sql import functions as F

from verdictlake.operators import calibration as K
from verdictlake.operators import cases as C
from verdictlake.operators import compare as J
from verdictlake.operators import evidence as E
from verdictlake.operators import fits, gates, retrieval, splits


def scored(spark, rows):
    """rows: (confidence of the first of two labels, correct, times)."""
    flat = [(float(c), int(not ok)) for c, ok, n in rows for _ in range(n)]
    frame = spark.createDataFrame([(i, "d", "choice", [c, 1 - c], y) for i, (c, y) in enumerate(flat)], "case_id long, domain string, kind string, probs array<double>, y int")
    return frame.repartition(5)


@pytest.mark.parametrize(
    "rows, ece, adaptive",
    [([(0.8, True, 80), (0.8, False, 20)], 0.0, 0.0), ([(0.9, True, 60), (0.9, False, 40)], 0.3, 0.3), ([(0.51, True, 204), (0.51, False, 196)], 0.0, 0.0)],
)
def test_report(spark, rows, ece, adaptive):
    r = K.calibration_report(scored(spark, rows), ["domain"]).first()
    assert (r.ece, r.mce, r.adaptive_ece) == (pytest.approx(ece, abs=1e-9), pytest.approx(ece, abs=1e-9), pytest.approx(adaptive, abs=1e-9))
    assert r.n == sum(n for *_, n in rows) and r.overconfidence == pytest.approx(r.confidence - r.accuracy)


def test_equal_mass_sees_what_equal_width_hides(spark):
    s = scored(spark, [(0.71, True, 50), (0.79, False, 50)])
    assert K.ece(K.reliability_bins(s, ["domain"], 10), ["domain"]).first().ece == pytest.approx(0.25)
    assert K.ece(K.equal_mass_bins(s, ["domain"], 10), ["domain"]).first().ece > 0.5


@pytest.mark.parametrize("parts", [1, 7])
def test_floor_does_not_depend_on_partitions_and_flags_overconfidence(spark, parts):
    s = scored(spark, [(0.97, True, 900), (0.97, False, 600)])
    floor = K.noise_floor(s.repartition(parts), ["domain"], trials=40).first()
    again = K.noise_floor(s, ["domain"], trials=40).first()
    assert floor.p95 == pytest.approx(again.p95, abs=1e-12)
    assert K.calibration_report(s, ["domain"]).first().ece > floor.p95


def test_pool_violators():
    assert fits.pool_violators([(1, 1.0, 1), (2, 0.0, 1), (3, 0.0, 1)]) == [(3, 1.0, 3)]
    assert [x for x, *_ in fits.pool_violators([(0.1, 0, 1), (0.2, 1, 1), (0.3, 0, 1), (0.4, 1, 1)])] == [0.1, 0.3, 0.4]


def walk_evenly(points, n_bins):
    """Equal-mass bins by walking distinct confidences in order: (bin, n, conf, acc)."""
    total = sum(n for _, n, _ in points)
    n_bins = min(n_bins, total)
    sums, seen, start, closed = [], 0, 0, 0
    for conf, n, right in points:
        at = min(closed, n_bins - 1)
        if at == len(sums):
            sums.append([0, 0.0, 0.0])
        seen += n
        sums[at] = [a + b for a, b in zip(sums[at], (n, conf * n, right))]
        if seen >= max(min(total, round((closed + 1) * (total / n_bins))), start + 1):
            start, closed = seen, closed + 1
    return [(k, n, pytest.approx(c / n), pytest.approx(r / n)) for k, (n, c, r) in enumerate(sums)]


def test_equal_mass_and_isotonic_by_cells_equal_a_walk(spark):
    rng = np.random.default_rng(12)
    groups = {
        "wide": np.round(rng.random(3000), 9),
        "narrow": np.round(0.97 + rng.random(2500) / 500, 9),
        "ties": rng.integers(1, 6, 1500) / 5,
        "one": np.full(500, 0.51),
        "few": np.array([0.2, 0.4, 0.4, 0.9]),
        None: np.round(rng.beta(8, 2, 1000), 3),
    }
    rows = [(g, float(c), float(rng.random() < c * c)) for g, cs in groups.items() for c in cs]
    # a second label takes what the first leaves; the confidence is the first's, so correct is y = 0
    table = spark.createDataFrame([(i, g, [c, 0.0], 0 if ok else 1) for i, (g, c, ok) in enumerate(rows)], "case_id long, g string, probs array<double>, y int").repartition(6)
    points = {}
    for g, c, ok in rows:
        n, s = points.setdefault(g, {}).get(c, (0, 0.0))
        points[g][c] = (n + 1, s + ok)
    for n_bins in (3, 15):
        got = {}
        for r in K.equal_mass_bins(table, ["g"], n_bins).orderBy("bin").collect():
            got.setdefault(r.g, []).append((r.bin, r.n, r.conf, r.acc))
        assert got == {g: walk_evenly([(c, n, s) for c, (n, s) in sorted(p.items())], n_bins) for g, p in points.items()}
    knots = fits.fit_isotonic(K.with_confidence(table), ["g"])
    got = {}
    for r in knots.orderBy("right").collect():
        got.setdefault(r.g, []).append((r.low, r.right, r.value))
    want = {}
    for g, p in points.items():
        if sum(n for n, _ in p.values()) >= fits.ISOTONIC_LEAST:
            blocks = fits.pool_violators([(c, s, n) for c, (n, s) in sorted(p.items())])
            want[g] = [(low, x, pytest.approx(s / n)) for low, (x, s, n) in zip([None, *(b[0] for b in blocks)], blocks)]
    assert got == want and len(want["wide"]) > 5
    # every row takes the first step whose right edge isn't below it, or the last; a group without steps stays as it is
    mapped = {r.case_id: r.probs[0] for r in fits.apply_isotonic(table, knots.where("g is null or g <> 'ties'"), ["g"]).collect()}
    assert len(mapped) == len(rows)
    for i, (g, c, _) in enumerate(rows):
        if g in want and g != "ties":
            value = next((v for _, right, v in got[g] if c <= right), got[g][-1][2])
            assert mapped[i] == pytest.approx(min(max(value, 1e-6), 1 - 1e-6))
        else:
            assert mapped[i] == c


def test_one_group_of_five_million_confidences(spark):
    n = 5_000_000
    conf = F.round(F.lit(0.5) + F.pmod(F.col("id") * 7919, F.lit(n)) / (2.0 * n), 9)
    wide = spark.range(n, numPartitions=8).select(F.lit("g").alias("g"), F.array(conf, F.lit(0.0)).alias("probs"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    bins = K.equal_mass_bins(wide, ["g"]).orderBy("bin").collect()
    assert [r.bin for r in bins] == list(range(15)) and sum(r.n for r in bins) == n and max(r.n for r in bins) - min(r.n for r in bins) <= 1
    assert "collect_list" not in K.equal_mass_bins(wide, ["g"])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 6])
def test_temperatures_of_many_groups_in_one_plan(spark, parts):
    rng = np.random.default_rng(13)
    raw = rng.normal(size=(2400, 4)) * 2
    rows = [(int(i % 6), (v[: 2 + i % 3] * (1 + i % 6)).tolist(), int(np.argmax(v[: 2 + i % 3] + rng.gumbel(size=2 + i % 3)))) for i, v in enumerate(raw)]
    table = spark.createDataFrame(rows, "g int, logits array<double>, y int").repartition(parts)
    got = {r.g: r for r in fits.fit_temperature(table, ["g"]).collect()}

    def loss(g, t):
        each = [np.log(np.exp((np.array(z) - max(z)) / t).sum()) - (z[y] - max(z)) / t for k, z, y in rows if k == g]
        return float(np.minimum(each, fits.WORST).mean())

    for g, r in got.items():
        lo, hi = fits.LOW, fits.HIGH
        while hi - lo > 1e-7:  # golden section on a loss with one valley
            a, b = hi - (hi - lo) * 0.618, lo + (hi - lo) * 0.618
            lo, hi = (lo, b) if loss(g, a) < loss(g, b) else (a, hi)
        assert r.t == pytest.approx(lo, abs=5e-4) and r.nll == pytest.approx(loss(g, r.t)) and not r.at_bound
    flat = fits.fit_temperature(spark.createDataFrame([([0.0, 0.0, 0.0], 1)] * 5, "logits array<double>, y int"), []).first()
    assert flat.at_bound and flat.nll == pytest.approx(np.log(3))
    yes = [(0, 2.5 * x, int(x + g > 0)) for x, g in zip(rng.normal(size=900).tolist(), rng.logistic(size=900).tolist())]
    binary = fits.fit_binary_temperature(spark.createDataFrame(yes, "g int, logit double, y int"), ["g"]).first()
    assert binary.t == pytest.approx(2.5, rel=0.25)


def test_temperature_recovers_a_scale(spark):
    base = spark.range(3000).select(F.array(*[F.lit(2.0) * F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0 for k in range(3)]).alias("raw"), "id")
    from verdictlake.functions.vectors import draw_label, softmax

    rows = base.select(F.transform("raw", lambda v: v * 3.0).alias("logits"), draw_label("id", softmax("raw")).alias("y"))
    got = fits.fit_temperature(rows.withColumn("g", F.lit(1)), ["g"]).first()
    assert 2.4 < got.t < 3.7 and not got.at_bound


def test_isotonic_apply_keeps_distributions(spark):
    s = scored(spark, [(0.9, True, 300), (0.9, False, 200)])
    knots = fits.fit_isotonic(K.with_confidence(s), ["domain"])
    r = fits.apply_isotonic(s, knots, ["domain"]).first()
    assert r.probs == [pytest.approx(0.6), pytest.approx(0.4)]


def test_gates_block_a_marginal_predictor(spark):
    report = spark.createDataFrame([("d", 6000, 0.0, 0.0, 0.5, 0.5, 0.5, 0.5, 0.01)], "domain string, n long, ece double, adaptive_ece double, accuracy double, baseline double, brier double, marginal_brier double, floor_p95 double")
    rows = gates.check_gates(report, ["domain"])
    v = gates.verdict(rows, ["domain"]).first()
    assert not v.passed and "accuracy_over_baseline" in v.blocked and "workhorse_ece" not in v.blocked


def test_common_cases_only(spark):
    answers = spark.createDataFrame([("a", "s", 1, 1), ("a", "s", 2, 0), ("b", "s", 1, 0)], "system string, slice string, case_id int, correct int")
    assert {r.system: (r.n, r.accuracy) for r in J.compare_systems(answers).collect()} == {"a": (1, 1.0), "b": (1, 0.0)}


def test_ratings_are_dropped_not_clipped(spark):
    rows = spark.createDataFrame([("a", "1", "2"), ("b", "9", "1"), ("c", None, "1"), ("d", "1.0", "0"), ("e", "1.5", "0")], "k string, r string, q string")
    got = C.score_cases(rows, ["k"], ["r", "q"], 5)
    assert {(r.k, r.qid, r.y) for r in got.collect()} == {("a", "r", 1), ("a", "q", 2), ("d", "r", 1), ("d", "q", 0)}


def test_word_spans_and_prf(spark):
    frame = spark.createDataFrame([(1, " ab  cdé\nf"), (2, "")], "k int, t string")
    got = [(r.w, r.start, r.end, r.word) for r in E.word_spans(frame, "t", ["k"]).orderBy("w").collect()]
    assert got == [(0, 1, 3, "ab"), (1, 5, 8, "cdé"), (2, 9, 10, "f")]
    marks = spark.createDataFrame([(1, i, g, p) for i, (g, p) in enumerate(zip([0, 1, 1, 0, 1], [0, 1, 0, 0, 1]))], "k int, w int, g int, p int").select("k", "w", F.col("g").cast("boolean").alias("gold"), F.col("p").cast("boolean").alias("predicted"))
    r = E.token_prf(marks, ["k"]).first()
    assert (r.precision, r.recall, r.f1) == (1.0, pytest.approx(2 / 3), pytest.approx(0.8))
    assert E.iou_f1(marks, ["k"]).first().iou_f1 == 1.0


def test_merge_spans(spark):
    text = "one two, three"
    tokens = spark.createDataFrame([(1, text, 0, 3, 0.9), (1, text, 4, 7, 0.7), (1, text, 9, 14, 0.6), (1, text, 2, 5, 0.1)], "k int, text string, start int, end int, score double")
    assert sorted((r.start, r.end, r.score) for r in E.merge_spans(tokens, ["k"]).collect()) == [(0, 7, 0.9), (9, 14, 0.6)]


def test_bm25_pads_with_the_lowest_indices(spark):
    options = spark.createDataFrame([(i, t) for i, t in enumerate(["red ring", "blue bolt", "green gear", "red gear"])], "idx long, text string")
    queries = spark.createDataFrame([(1, "gears please"), (2, "zzz")], "qid long, text string")
    got = {}
    for r in retrieval.bm25_shortlist(queries, options, 3).orderBy("rank").collect():
        got.setdefault(r.qid, []).append(r.idx)
    assert got == {1: [2, 3, 0], 2: [0, 1, 2]}


def test_splits_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).withColumn("slice", F.col("id") % 3)
    first = {r.id for r in splits.sample_per_slice(rows.repartition(7), ["slice"], "id", 20).collect()}
    assert first == {r.id for r in splits.sample_per_slice(rows.coalesce(1), ["slice"], "id", 20).collect()} and len(first) == 60
    assert splits.balance_by_label(rows.where("id < 500 or slice = 0"), "slice", "id").groupBy("slice").count().select("count").distinct().count() == 1


def test_resampling_accepts_a_real_help_only(spark):
    from verdictlake.operators import bootstrap

    # 60 % right at a stated 90 %: the arm that states 60 % helps; swapped, it harms
    rows = spark.range(1500).select(F.col("id").alias("case_id"), F.lit("d").alias("domain"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 10 < 6).cast("double").alias("ok"))
    over = rows.select("case_id", "domain", "y", F.lit(0.9).alias("conf_a"), F.col("ok").alias("ok_a"), F.lit(0.6).alias("conf_b"), F.col("ok").alias("ok_b"))
    got = bootstrap.help_is_real(over, ["domain"], resamples=40).first()
    assert (got.counted, got.better, got.accepted) == (40, 40, True)
    same = over.withColumn("conf_b", F.lit(0.9))
    assert not bootstrap.help_is_real(same, ["domain"], resamples=40).first().accepted
    one_label = over.withColumn("y", F.lit(1))
    assert bootstrap.help_is_real(one_label, ["domain"], resamples=10).count() == 0


def test_letters_take_the_first_occurrence_and_return_to_declared_order(spark):
    from verdictlake.operators import serving

    t = spark.createDataFrame([(1, [2, 0, 1], 0, " A", -0.1), (1, [2, 0, 1], 1, "B", -1.0), (1, [2, 0, 1], 2, "A", -9.0), (1, [2, 0, 1], 3, "x", -0.5)], "k int, order array<int>, pos int, token string, logprob double")
    p = serving.letters_to_dist(t, ["k"]).first().probs
    assert max(range(3), key=p.__getitem__) == 2 and min(range(3), key=p.__getitem__) == 1


def test_isotonic_parts_that_span_batches(spark):
    rows = [(i, (i * 7919 % 1000) / 1000, float(i * 31 % 7 < 3)) for i in range(3000)]
    table = spark.createDataFrame(rows, "case_id long, conf double, correct double").withColumn("g", F.lit("a"))
    want = fits.fit_isotonic(table, ["g"]).orderBy("right").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert fits.fit_isotonic(table, ["g"]).orderBy("right").collect() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
