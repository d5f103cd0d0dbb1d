"""A user's scorer and tokenizer, interval sweeps and stored sketches."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictlake.operators import calibration as K
from verdictlake.operators import compare as J
from verdictlake.operators import evidence as E
from verdictlake.operators import scoring


def loader():
    """A loader of a scorer of padded batches whose padding is masked out; a nested function, so that workers need no test module."""

    def padded(rows):
        n = rows["n"].to_numpy()
        at = np.arange(n.max())
        z = np.where(at < n[:, None], rows["x"].to_numpy()[:, None] * (at + 1), -np.inf)
        return [r[:k] for r, k in zip(z, n)]

    return lambda: padded


def questions(spark, rows=240):
    return spark.range(rows).select("id", (F.col("id") % 7 / 7.0).alias("x"), (2 + F.col("id") % 3).cast("int").alias("n"), (1 + F.col("id") * 37 % 50).alias("size"))


def test_budget_cuts_bound_rows_times_longest_squared():
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randrange(1, 40) for _ in range(rng.randrange(0, 60))]
        cuts = scoring.budget_cuts(lengths, 2000, 9)
        assert [i for a, b in cuts for i in range(a, b)] == list(range(len(lengths)))
        assert all(b - a == 1 or (b - a) * max(lengths[a:b]) ** 2 <= 2000 for a, b in cuts) and all(b - a <= 9 for a, b in cuts)
        # no two neighbours would fit together with the first row of the second
        assert all((b - a + 1) * max(lengths[a : b + 1]) ** 2 > 2000 or b - a == 9 for a, b in cuts[:-1])


@pytest.mark.parametrize("budget, parts", [(1, 1), (3000, 4), (10**9, 1), (10**9, 7)])
def test_answers_do_not_depend_on_the_batch(spark, budget, parts):
    alone = {r.id: r.logits for r in scoring.score_with(questions(spark), loader(), "size", "n", budget=1).collect()}
    got = scoring.score_with(questions(spark).repartition(parts), loader(), "size", "n", budget=budget).collect()
    assert {r.id: r.logits for r in got} == alone and all(not r.reasons for r in got)
    assert all(np.isfinite(r.logits).all() and len(r.logits) == r.n for r in got)


def test_rows_keep_their_order_and_few_rows_are_no_special_case(spark):
    one = scoring.score_with(questions(spark).repartition(1).sortWithinPartitions("id"), loader(), "size", "n", budget=5000)
    assert [r.id for r in one.collect()] == list(range(240))
    assert scoring.score_with(questions(spark).where("false"), loader(), "size", "n").count() == 0
    assert scoring.score_with(questions(spark).where("id = 5"), loader(), "size", "n").first().logits == pytest.approx([5 / 7 * (k + 1) for k in range(4)])


def test_a_worker_loads_once_and_faults_are_told(spark, tmp_path):
    def load():
        with open(f"{tmp_path}/loads", "a") as f:
            f.write("x")

        def bad(rows):
            return [None if i % 4 == 0 else [1.0] if i % 4 == 1 else [float("nan")] * n if i % 4 == 2 else [0.0] * n for i, n in zip(rows["id"], rows["n"])]

        return bad

    q = questions(spark).repartition(3)
    out = scoring.score_with(q, load, "size", "n", budget=100)
    want = [["missing"], ["count"], ["not finite"], []]
    assert all(r.reasons == want[r.id % 4] for r in out.collect())
    assert len(open(f"{tmp_path}/loads").read()) <= 4  # a copy for each worker, not for each of the batches
    with pytest.raises(Exception, match="returned 1 answers"):
        scoring.score_with(q, lambda: lambda rows: [[0.0]], "size", "n", budget=10**9).collect()


def test_exact_tokens_equal_a_loop(spark):
    rows = [(1, "one two", None), (2, None, None), (3, "", "a b c"), (4, "x" * 1000, "y z")]
    count = lambda: lambda texts: [len(t.split()) for t in texts]
    df = spark.createDataFrame(rows, "k int, a string, b string").repartition(2)
    got = {r.k: r.tokens for r in scoring.exact_tokens(df, count, F.array("a", "b")).collect()}
    assert got == {k: sum(len(t.split()) for t in (a, b) if t is not None) for k, a, b in rows}


def test_sweep_equals_all_pairs(spark):
    rng = random.Random(2)
    words, spans = [], []
    for k in (None, 1, 2):
        at = 0
        for w in range(60):
            at += rng.randrange(0, 3)
            end = at + rng.randrange(1, 7)
            words.append((k, w, at, end, w % 2 == 0))
            at = end
        for _ in range(12 if k else 3):
            s = rng.randrange(0, at)
            spans.append((k, s, s + rng.choice([0, 1, 2, 30])))
    w = spark.createDataFrame(words, "k int, w int, start int, end int, gold boolean").repartition(3)
    s = spark.createDataFrame(spans, "k int, start int, end int").repartition(2)
    want = {(k, i): any(q == k and a < end and start < b for q, a, b in spans) for k, i, start, end, _ in words}
    got = E.highlighted(w, s, ["k"])
    assert {(r.k, r.w): r.marked for r in got.collect()} == want and got.columns == ["k", "w", "start", "end", "gold", "marked"]
    pairs = E.touching(w.where("k is not null"), s.where("k is not null").withColumn("score", F.col("start") * 1.0), ["k"]).collect()
    expected = sorted((k, i, float(a)) for k, i, start, end, _ in words if k for q, a, b in spans if q == k and a < end and start < b)
    assert sorted((r.k, r.w, r.score) for r in pairs) == expected


def test_token_labels_trim_the_leading_space(spark):
    text = "a bad word"
    tokens = spark.createDataFrame([(1, text, 0, 1), (1, text, 1, 5), (1, text, 5, 10), (2, text, 1, 2)], "k int, text string, start int, end int")
    gold = spark.createDataFrame([(1, 2, 5), (2, 0, 10)], "k int, start int, end int")
    got = E.token_labels(tokens, gold, ["k"]).orderBy("k", "start").collect()
    assert [(r.k, r.start, r.label) for r in got] == [(1, 0, 0), (1, 1, 1), (1, 5, 0), (2, 1, 0)]


def runs(marks):
    out, start = [], None
    for i, m in enumerate([*marks, False]):
        if m and start is None:
            start = i
        if not m and start is not None:
            out.append(set(range(start, i)))
            start = None
    return out


def test_iou_equals_all_pairs_of_runs(spark):
    rng = random.Random(3)
    cases = {k: [(rng.random() < 0.5, rng.random() < 0.5) for _ in range(rng.randrange(1, 40))] for k in range(30)} | {99: [(False, False)] * 4, 98: [(True, False)] * 4}
    table = spark.createDataFrame([(k, i, g, p) for k, m in cases.items() for i, (g, p) in enumerate(m)], "k int, w int, gold boolean, predicted boolean")
    want = {}
    for k, m in cases.items():
        g, p = runs([x for x, _ in m]), runs([y for _, y in m])
        if g or p:
            good = lambda a, others: any(len(a & b) / len(a | b) >= 0.5 for b in others)
            r, q = (sum(good(a, p) for a in g) / len(g) if g else 0.0), (sum(good(b, g) for b in p) / len(p) if p else 0.0)
            want[k] = pytest.approx(2 * r * q / (r + q) if r + q else 0.0)
    assert {r.k: r.iou_f1 for r in E.iou_f1(table, ["k"]).collect()} == want


def test_a_long_text_with_many_spans_takes_seconds(spark):
    words = spark.range(100_000, numPartitions=4).select(F.lit(1).alias("k"), F.col("id").alias("w"), (F.col("id") * 6).alias("start"), (F.col("id") * 6 + 5).alias("end"))
    spans = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 29).alias("start"), (F.col("id") * 29 + 200_000).alias("end"))
    began = time.time()
    assert E.highlighted(words, spans, ["k"]).where("marked").count() == 100_000
    assert time.time() - began < 60


def test_sketches_of_days_merge_to_the_whole(spark):
    rows = spark.range(30_000, numPartitions=6).select(F.col("id").alias("case_id"), F.lit("d").alias("domain"), (F.col("id") % 9).alias("day"), F.array(F.pmod(F.col("id") * 7919, F.lit(30_000)) / 30_000.0, F.lit(0.0)).alias("probs"))
    twice = rows.unionByName(rows)
    r = K.approximate_report(K.daily_sketches(twice, ["domain"], "day"), ["domain"]).first()
    assert r.n == 60_000 and r.cases == pytest.approx(30_000, rel=0.05) and r.quantiles == [pytest.approx(q, abs=0.02) for q in (0.05, 0.5, 0.95)]
    some = K.approximate_report(K.daily_sketches(twice, ["domain"], "day").where("day < 3"), ["domain"]).first()
    assert some.n == 20_004 and some.cases == pytest.approx(10_002, rel=0.05)


def test_parity_refuses_other_labels_and_counts_answers_alone(spark):
    schema = "k int, labels array<string>, probs array<double>"
    a = spark.createDataFrame([(1, ["x", "y"], [0.9, 0.1]), (2, ["x", "y"], [0.2, 0.8])], schema)
    r = J.parity(a, a.where("k = 1"), ["k"]).first()
    assert (r.n, r.alone, r.agreement, r.max_diff, r.passed) == (1, 1, 1.0, 0.0, False)
    assert J.parity(a, a, ["k"]).first().passed
    with pytest.raises(Exception, match="different labels"):
        J.parity(a, a.withColumn("labels", F.reverse("labels")), ["k"]).collect()


def test_folded_margins_equal_a_loop_over_replicates(spark):
    from verdictlake.operators import bootstrap as B

    rng = np.random.default_rng(4)
    rows = [(i, "d" if i % 3 else None, int(rng.integers(0, 3)), *(x for _ in "ab" for x in (round(float(rng.random()), 3), float(rng.integers(0, 2))))) for i in range(400)]
    table = spark.createDataFrame(rows, "case_id long, domain string, y int, conf_a double, ok_a double, conf_b double, ok_b double").where("domain is not null").repartition(5)
    got = {r.rep: (r.err_a, r.err_b, r.labels) for r in B.replicate_errors(table, ["domain"], resamples=20).collect()}
    kept = [r for r in rows if r[1]]
    weight = np.searchsorted(B.POISSON, K.draws([str(r[0]) for r in kept], 20, "boot"), "right")
    for rep, (err_a, err_b, labels) in got.items():
        for want, c in ((err_a, 3), (err_b, 5)):
            order, before, mass = sorted({r[c] for r in kept}), 0, {}
            for v in order:
                mass[v] = before * 15 // len(kept)
                before += sum(r[c] == v for r in kept)
            errors = []
            for bin_of in (lambda r: min(int(r[c] / (1.0 / 15)), 14), lambda r: mass[r[c]]):
                gaps = {}
                for r, w in zip(kept, weight[:, rep]):
                    gaps[bin_of(r)] = gaps.get(bin_of(r), 0.0) + w * (r[c + 1] - r[c])
                errors.append(sum(map(abs, gaps.values())) / weight[:, rep].sum())
            assert want == pytest.approx(max(errors), abs=1e-8)
        assert labels == (len({r[2] for r, w in zip(kept, weight[:, rep]) if w}) > 1)
