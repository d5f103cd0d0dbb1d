"""Registered queries over calibration, fits, comparisons, splits, retrieval, evidence and streams, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import token_counts
from ..operators import calibration as K
from ..operators import cases as C
from ..operators import compare as J
from ..operators import evidence as E
from ..operators import fits, gates, retrieval, splits
from ..sources.records import reliability_diagram
from ..sources.shared import stage
from ..streaming import monitor
from . import views
from .registry import draw_sql, register, rounded, scored_sql, tokens_sql, u_sql

REPORT = "sum(n) AS n, round(sum(abs(c - f)) / sum(n), 6) AS ece"
EQUAL = """
    g AS (SELECT domain, conf, count(*) AS n, sum(correct) AS r FROM sc GROUP BY ALL),
    o AS (SELECT *, row_number() OVER w AS k, sum(n) OVER (PARTITION BY domain) AS total FROM g WINDOW w AS (PARTITION BY domain ORDER BY conf)),
    walk AS (
      SELECT domain, k, n AS seen, 0::HUGEINT AS bin, CASE WHEN n >= greatest(least(total, round_even(1 * (total / least(15, total)), 0)), 1) THEN n ELSE 0 END AS start, conf, n, r, total FROM o WHERE k = 1
      UNION ALL
      SELECT o.domain, o.k, walk.seen + o.n, CASE WHEN walk.start = walk.seen THEN walk.bin + 1 ELSE walk.bin END,
        CASE WHEN walk.seen + o.n >= greatest(least(o.total, round_even((CASE WHEN walk.start = walk.seen THEN walk.bin + 1 ELSE walk.bin END + 1) * (o.total / least(15, o.total)), 0)), walk.start + 1) THEN walk.seen + o.n ELSE walk.start END,
        o.conf, o.n, o.r, o.total
      FROM walk JOIN o ON o.domain = walk.domain AND o.k = walk.k + 1)"""


# ---- calibration ------------------------------------------------------------------------------


@register(f"""WITH RECURSIVE {scored_sql()}, {EQUAL}, b AS (SELECT domain, bin, count(*) AS n, sum(conf) AS f, sum(correct) AS c, sum(nll) AS l, sum(brier) AS q FROM sc GROUP BY ALL),
    eb AS (SELECT domain, sum(n) AS n, sum(conf * n) / sum(n) AS conf, sum(r) / sum(n) AS acc FROM walk GROUP BY domain, least(bin, 14)), ae AS (SELECT domain, round(sum(n * abs(acc - conf)) / sum(n), 6) AS adaptive_ece FROM eb GROUP BY domain)
    SELECT b.domain, any_value(adaptive_ece) AS adaptive_ece, {REPORT}, round(max(abs(c - f) / n), 6) AS mce, round(sum(q) / sum(n), 6) AS brier, round(sum(l) / sum(n), 6) AS nll, round(sum(c) / sum(n), 6) AS accuracy, round(sum(f) / sum(n), 6) AS confidence,
    round(sum(f) / sum(n) - sum(c) / sum(n), 6) AS overconfidence FROM b JOIN ae ON ae.domain = b.domain GROUP BY b.domain""")
def k7_calibration_report(spark, sf_dir):
    out = K.calibration_report(views.event_scored(spark, sf_dir), ["domain"])
    return rounded(out, "ece", "mce", "adaptive_ece", "brier", "nll", "accuracy", "confidence", "overconfidence")


@register(f"""WITH {scored_sql()}, s AS (SELECT DISTINCT domain, unnest(range(15)) AS bin FROM sc),
    b AS (SELECT domain, bin, count(*) AS n, avg(conf) AS conf, avg(correct) AS acc FROM sc GROUP BY ALL)
    SELECT s.domain, CAST(s.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(conf, 0), 6) AS conf, round(coalesce(acc, 0), 6) AS acc FROM s LEFT JOIN b ON s.domain = b.domain AND s.bin = b.bin""")
def k1_reliability_bins(spark, sf_dir):
    return rounded(K.reliability_bins(views.event_scored(spark, sf_dir), ["domain"]), "conf", "acc")


@register(f"""WITH RECURSIVE {scored_sql()}, {EQUAL}
    SELECT domain, CAST(least(bin, 14) AS INTEGER) AS bin, CAST(sum(n) AS BIGINT) AS n, round(sum(conf * n) / sum(n), 6) AS conf, round(sum(r) / sum(n), 6) AS acc FROM walk GROUP BY domain, least(bin, 14)""")
def k2_equal_mass_bins(spark, sf_dir):
    return rounded(K.equal_mass_bins(views.event_scored(spark, sf_dir), ["domain"]), "conf", "acc")


@register(f"""WITH RECURSIVE {scored_sql()}, {EQUAL},
    b AS (SELECT domain, least(bin, 14) AS bin, sum(n) AS n, sum(conf * n) / sum(n) AS conf, sum(r) / sum(n) AS acc FROM walk GROUP BY domain, least(bin, 14))
    SELECT domain, round(sum(n * abs(acc - conf)) / sum(n), 6) AS adaptive_ece, round(max(abs(acc - conf)), 6) AS adaptive_mce FROM b GROUP BY domain""")
def k4_adaptive_ece(spark, sf_dir):
    bins = K.equal_mass_bins(views.event_scored(spark, sf_dir), ["domain"])
    return rounded(K.ece(bins, ["domain"], "adaptive_ece"), "adaptive_ece", "adaptive_mce")


@register(f"""WITH {scored_sql()}, x AS (SELECT unnest(['domain:' || domain, 'kind:choice', 'all']) AS slice, bin, conf, correct, nll, brier FROM sc),
    b AS (SELECT slice, bin, count(*) AS n, sum(conf) AS f, sum(correct) AS c, sum(nll) AS l, sum(brier) AS q FROM x GROUP BY ALL)
    SELECT slice, {REPORT}, round(sum(q) / sum(n), 6) AS brier, round(sum(l) / sum(n), 6) AS nll, round(sum(c) / sum(n), 6) AS accuracy FROM b GROUP BY slice""")
def k11_slice_reports(spark, sf_dir):
    return rounded(K.slice_reports(views.event_scored(spark, sf_dir)), "ece", "brier", "nll", "accuracy")


def floor_sql(source: str, n: int = 200) -> str:
    """CTEs up to fl (domain, n, mean, p95) from a scored source."""
    return f"""
    fl_h AS (SELECT domain, case_id, bin, conf, blk, sha256('floor|' || CAST(blk AS VARCHAR) || '|' || CAST(case_id AS VARCHAR)) AS dg FROM {source}, (SELECT unnest(range({-(-n // 16)})) AS blk)),
    fl_d AS (SELECT domain, bin, conf, blk * 16 + k AS t, ('0x' || substr(dg, k * 4 + 1, 4))::UBIGINT / 65536.0 AS u FROM fl_h, (SELECT unnest(range(16)) AS k) WHERE blk * 16 + k < {n}),
    fl_b AS (SELECT domain, t, bin, count(*) AS n, sum(CASE WHEN u < conf THEN 1.0 ELSE 0.0 END - conf) AS gap FROM fl_d GROUP BY ALL),
    fl_e AS (SELECT domain, t, sum(abs(gap)) / sum(n) AS ece, sum(n) AS n FROM fl_b GROUP BY ALL),
    fl AS (SELECT domain, CAST(max(n) AS BIGINT) AS n, avg(ece) AS mean, list_sort(list(ece))[{round(0.95 * (n - 1)) + 1}] AS p95 FROM fl_e GROUP BY domain)"""


@register(f"WITH {scored_sql()}, {floor_sql('sc')} SELECT domain, n, round(mean, 6) AS mean, round(p95, 6) AS p95 FROM fl")
def k8_noise_floor(spark, sf_dir):
    return rounded(K.noise_floor(views.event_scored(spark, sf_dir), ["domain"]), "mean", "p95")


@register(f"""WITH {scored_sql()}, c AS (SELECT domain, y, count(*) AS n, sum(correct) AS r FROM sc GROUP BY ALL)
    SELECT domain, CAST(sum(n) AS BIGINT) AS n, round(sum(r) / sum(n), 6) AS accuracy, round(max(n) / sum(n), 6) AS baseline, round(sum(r) / sum(n) - max(n) / sum(n), 6) AS lift FROM c GROUP BY domain""")
def k12_per_question(spark, sf_dir):
    return rounded(K.per_question(views.event_scored(spark, sf_dir), ["domain"]), "accuracy", "baseline", "lift")


def _halves(spark, sf_dir):
    s = splits.hash_holdout(views.event_scored(spark, sf_dir), "case_id", 0.3)
    return s.where("not held_out"), s.where("held_out")


HALVES = f"{scored_sql()}, h AS (SELECT *, {draw_sql('holdout', 'case_id')} < 0.3 AS held FROM sc)"


@register(f"""WITH {HALVES}, c AS (SELECT domain, y, count(*) AS n FROM h WHERE NOT held GROUP BY ALL), m AS (SELECT domain, y AS mode FROM c QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, y) = 1)
    SELECT domain, count(*) AS n, round(avg(CASE WHEN y = mode THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM h JOIN m USING (domain) WHERE held GROUP BY domain""")
def k14_baseline_accuracy(spark, sf_dir):
    return rounded(K.baseline_accuracy(*_halves(spark, sf_dir), ["domain"]), "accuracy")


@register(f"""WITH {HALVES}, c AS (SELECT domain, y, count(*) AS n FROM h WHERE NOT held GROUP BY ALL), g AS (SELECT d.domain, k.y, coalesce(n, 0) + 1.0 AS n FROM (SELECT DISTINCT domain FROM h) d, (SELECT unnest(range(5)) AS y) k LEFT JOIN c ON c.domain = d.domain AND c.y = k.y),
    s AS (SELECT domain, list(n ORDER BY y) AS ns, sum(n) AS t FROM g GROUP BY domain)
    SELECT domain, count(*) AS n, round(avg(list_sum(list_transform(range(5), lambda i: pow(ns[i + 1] / t - CASE WHEN i = y THEN 1 ELSE 0 END, 2)))), 6) AS brier, round(avg(-ln(ns[y + 1] / t)), 6) AS nll FROM h JOIN s USING (domain) WHERE held GROUP BY domain""")
def k15_marginal_scores(spark, sf_dir):
    return rounded(K.marginal_scores(*_halves(spark, sf_dir), ["domain"]), "brier", "nll")


@register(f"""WITH {scored_sql()}, b AS (SELECT domain, greatest(ceil(conf * 10) - 1, 0) AS bin, count(*) AS n, sum(correct - conf) AS gap FROM sc GROUP BY ALL) SELECT domain, round(sum(abs(gap)) / sum(n), 6) AS ece FROM b GROUP BY domain""")
def k19_ten_bin_ece(spark, sf_dir):
    return rounded(K.ten_bin_ece(views.event_scored(spark, sf_dir), ["domain"]), "ece")


@register(f"""WITH {scored_sql()} SELECT domain, round(quantile_disc(conf, 0.5), 6) AS p50, round(quantile_disc(conf, 0.99), 6) AS p99 FROM sc GROUP BY domain""")
def k16_nearest_rank(spark, sf_dir):
    s = K.with_confidence(views.event_scored(spark, sf_dir))
    out = s.groupBy("domain").agg(*[F.expr(f"percentile_disc({q}) within group (order by conf)").alias(n) for q, n in ((0.5, "p50"), (0.99, "p99"))])
    return rounded(out, "p50", "p99")


@register(f"""WITH {scored_sql()}, s AS (SELECT unnest(range(15)) AS bin), b AS (SELECT bin, count(*) AS n, avg(conf) AS conf, avg(correct) AS acc FROM sc GROUP BY bin)
    SELECT CAST(s.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(acc, 0) - coalesce(conf, 0), 6) AS gap, rpad(repeat('#', CAST(round(coalesce(acc, 0) * 40) AS INTEGER)), 40, '.') AS bar FROM s LEFT JOIN b USING (bin)""")
def s12_reliability_diagram(spark, sf_dir):
    rows = K.reliability_bins(views.event_scored(spark, sf_dir).withColumn("one", F.lit(1)), ["one"])
    return rounded(reliability_diagram(rows).select("bin", "n", "gap", "bar"), "gap")


# ---- fits --------------------------------------------------------------------------------------

GRID = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 4.0]


@register(f"""WITH {scored_sql()}, x AS (SELECT domain, t, logits, y FROM sc, (SELECT unnest([{', '.join(map(str, GRID))}]::DOUBLE[]) AS t)), e AS (SELECT domain, t, y, list_transform(logits, lambda v: exp((v - list_max(logits)) / t)) AS ex FROM x)
    SELECT domain, t, round(avg(-ln(greatest(ex[y + 1] / list_sum(ex), 1e-12))), 6) AS nll FROM e GROUP BY ALL""")
def f1_temperature_losses(spark, sf_dir):
    return rounded(fits.temperature_losses(views.event_scored(spark, sf_dir), ["domain"], GRID), "nll")


def _fit_sql(source: str = "sc", rounds: int = fits.ROUNDS, grid: int = fits.GRID) -> str:
    """CTEs up to fit (domain, t, nll, at_bound): the grid of each round lies between the neighbours of the best point before."""
    out = [f"w0 AS (SELECT DISTINCT domain, {fits.LOW}::DOUBLE AS lo, {fits.HIGH}::DOUBLE AS hi, 0.0::DOUBLE AS t, 0.0::DOUBLE AS nll FROM {source})"]
    for r in range(1, rounds + 1):
        out.append(f"""x{r} AS (SELECT {source}.domain, lo + i * ((hi - lo) / {grid - 1}) AS t, (hi - lo) / {grid - 1} AS step, logits, y FROM {source} JOIN w{r - 1} USING (domain), (SELECT unnest(range({grid})) AS i)),
    l{r} AS (SELECT domain, t, max(step) AS step, avg(-ln(greatest(ex[y + 1] / list_sum(ex), 1e-12))) AS nll FROM (SELECT domain, t, step, y, list_transform(logits, lambda v: exp((v - list_max(logits)) / t)) AS ex FROM x{r}) GROUP BY domain, t),
    w{r} AS (SELECT domain, greatest({fits.LOW}::DOUBLE, t - step) AS lo, least({fits.HIGH}::DOUBLE, t + step) AS hi, t, nll FROM l{r} QUALIFY row_number() OVER (PARTITION BY domain ORDER BY nll, t) = 1)""")
    out.append(f"fit AS (SELECT domain, t, nll, t <= {fits.LOW} + 0.01 OR t >= {fits.HIGH} - 0.01 AS at_bound FROM w{rounds})")
    return ", ".join(out)


@register(f"WITH {scored_sql()}, {_fit_sql()} SELECT domain, round(t, 6) AS t, round(nll, 6) AS nll, at_bound FROM fit")
def f1_fit_temperature(spark, sf_dir):
    return rounded(fits.fit_temperature(views.event_scored(spark, sf_dir).select("domain", "logits", "y"), ["domain"]), "t", "nll")


@register(f"WITH {scored_sql()}, yn AS (SELECT domain, [0.0::DOUBLE, 2 * (logits[2] - logits[1])] AS logits, CASE WHEN y = 1 THEN 1 ELSE 0 END AS y FROM sc), {_fit_sql('yn')} SELECT domain, round(t, 6) AS t, round(nll, 6) AS nll, at_bound FROM fit")
def f2_fit_binary(spark, sf_dir):
    """Each event as a yes/no about the second type, its logit twice the lead over the first type's."""
    rows = views.event_scored(spark, sf_dir).select("domain", (2 * (F.col("logits")[1] - F.col("logits")[0])).alias("logit"), (F.col("y") == 1).alias("y"))
    return rounded(fits.fit_binary_temperature(rows, ["domain"]), "t", "nll")


# the fitted value at a point is the largest over all starts before it of the least mean to any end behind it
PAV = f"""{scored_sql()}, r AS (SELECT domain, conf AS x, sum(correct) AS s, CAST(count(*) AS DOUBLE) AS w FROM sc GROUP BY ALL),
    c AS (SELECT domain, x, s, w, sum(s) OVER o AS cs, sum(w) OVER o AS cw FROM r WINDOW o AS (PARTITION BY domain ORDER BY x)),
    m AS (SELECT a.domain, a.x AS i, b.x AS j, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS mean FROM c a JOIN c b ON a.domain = b.domain AND a.x <= b.x),
    lo AS (SELECT domain, i, j, min(mean) OVER (PARTITION BY domain, i ORDER BY j DESC) AS lo FROM m), f AS (SELECT domain, j AS x, max(lo) AS v FROM lo GROUP BY ALL)"""


@register(f"""WITH {PAV}, k AS (SELECT domain, max(x) AS "right", round(v, 9) AS value FROM f GROUP BY domain, round(v, 9)) SELECT domain, lag("right") OVER (PARTITION BY domain ORDER BY "right") AS low, "right", value FROM k""")
def f5_fit_isotonic(spark, sf_dir):
    points = K.with_confidence(views.event_scored(spark, sf_dir)).select("domain", "conf", "correct")
    return fits.fit_isotonic(points, ["domain"]).select("domain", "low", "right", F.round("value", 9).alias("value"))


@register(f"""WITH {PAV}, a AS (SELECT case_id, probs, list_position(probs, list_max(probs)) - 1 AS top, list_max(probs) AS p, greatest(1e-6, least(1 - 1e-6, v)) AS g FROM sc JOIN f ON f.domain = sc.domain AND f.x = sc.conf)
    SELECT case_id, i AS idx, round(CASE WHEN i = top THEN g ELSE probs[i + 1] * (1 - g) / greatest(1 - p, 1e-12) END, 6) AS p FROM a, (SELECT unnest(range(5)) AS i)""")
def f6_apply_isotonic(spark, sf_dir):
    scored = views.event_scored(spark, sf_dir).select("case_id", "domain", "probs", "y")
    knots = fits.fit_isotonic(K.with_confidence(scored), ["domain"])
    mapped = fits.apply_isotonic(scored, knots, ["domain"])
    return mapped.select("case_id", F.posexplode("probs").alias("idx", "p")).select("case_id", F.col("idx").cast("long").alias("idx"), F.round("p", 6).alias("p"))


CONFORMAL = f"{HALVES}, f AS (SELECT domain, count(*) AS n, list_sort(list(round(1 - probs[y + 1], 9))) AS ss FROM h WHERE NOT held GROUP BY domain), t AS (SELECT domain, n, ss[CAST(least(ceil((n + 1) * (1.0::DOUBLE - 0.1)), n) AS BIGINT)] AS threshold FROM f)"


@register(f"WITH {CONFORMAL} SELECT domain, n, round(threshold, 6) AS threshold FROM t")
def f7_fit_conformal(spark, sf_dir):
    return rounded(fits.fit_conformal(_halves(spark, sf_dir)[0], ["domain"]), "threshold")


@register(f"""WITH {CONFORMAL}, x AS (SELECT domain, y, list_filter(range(5), lambda i: round(1 - probs[i + 1], 9) <= threshold) AS s FROM h JOIN t USING (domain) WHERE held)
    SELECT domain, count(*) AS n, round(avg(CASE WHEN list_contains(s, y) THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(len(s)), 6) AS mean_size FROM x GROUP BY domain""")
def k10_conformal_coverage(spark, sf_dir):
    fit, test = _halves(spark, sf_dir)
    return rounded(fits.conformal_coverage(test, fits.fit_conformal(fit, ["domain"]), ["domain"]), "coverage", "mean_size")


APS = f"""{HALVES}, q AS (SELECT case_id, domain, held, y, probs, round(list_sum(list_transform(range(5), lambda i: CASE WHEN probs[i + 1] > probs[y + 1] OR (probs[i + 1] = probs[y + 1] AND i <= y) THEN probs[i + 1] ELSE 0 END)), 9) AS sco FROM h),
    f AS (SELECT domain, list_sort(list(sco)) AS ss, count(*) AS n FROM q WHERE NOT held GROUP BY domain), t AS (SELECT domain, ss[CAST(least(ceil((n + 1) * (1.0::DOUBLE - 0.1)), n) AS BIGINT)] AS threshold FROM f),
    z AS (SELECT case_id, domain, y, threshold, i, sum(probs[i + 1]) OVER (PARTITION BY case_id ORDER BY probs[i + 1] DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mass FROM q JOIN t USING (domain), (SELECT unnest(range(5)) AS i) WHERE held),
    u AS (SELECT case_id, domain, y, count(*) AS size, bool_or(i = y) AS hit FROM z WHERE round(coalesce(mass, 0), 9) < threshold GROUP BY ALL),
    e AS (SELECT DISTINCT case_id, domain FROM q WHERE held)"""


@register(f"""WITH {APS}, v AS (SELECT e.domain, count(*) AS n, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS coverage, avg(coalesce(size, 0)) AS mean_size FROM e LEFT JOIN u USING (case_id) GROUP BY e.domain)
    SELECT domain, n, round(coverage, 6) AS coverage, round(mean_size, 6) AS mean_size, round(0.9 - 3 * sqrt(0.9 * (1.0::DOUBLE - 0.9) / n), 6) AS "limit", coverage >= 0.9 - 3 * sqrt(0.9 * (1.0::DOUBLE - 0.9) / n) AS passed FROM v""")
def f7_aps_coverage(spark, sf_dir):
    fit, test = _halves(spark, sf_dir)
    out = gates.coverage_gate(fits.conformal_coverage(test, fits.fit_conformal(fit, ["domain"], method="aps"), ["domain"], "aps"), 0.9)
    return rounded(out, "coverage", "mean_size", "limit")


GATES = (("sample_size", "CAST(n AS DOUBLE)", 5000, ">="), ("gate_is_testable", "p95", 0.025, "<="), ("accuracy_over_baseline", "accuracy - baseline", 0.05, ">="), ("accuracy_over_chance", "(accuracy - baseline) / (1 - baseline)", 0.25, ">="), ("brier_over_marginal", "1 - brier / marginal", 0.02, ">="), ("workhorse_ece", "ece", 0.05, "<="), ("workhorse_adaptive_ece", "adaptive", 0.05, "<="))


@register(f"""WITH RECURSIVE {HALVES}, held AS (SELECT * FROM h WHERE held), {EQUAL.replace('FROM sc', 'FROM held')}, {floor_sql('held')},
    ab AS (SELECT domain, least(bin, 14) AS bin, sum(n) AS n, sum(conf * n) / sum(n) AS conf, sum(r) / sum(n) AS acc FROM walk GROUP BY domain, least(bin, 14)), ad AS (SELECT domain, sum(n * abs(acc - conf)) / sum(n) AS adaptive FROM ab GROUP BY domain),
    rb AS (SELECT domain, bin, count(*) AS n, sum(conf) AS f, sum(correct) AS c, sum(brier) AS q FROM held GROUP BY ALL), rp AS (SELECT domain, sum(n) AS n, sum(abs(c - f)) / sum(n) AS ece, sum(c) / sum(n) AS accuracy, sum(q) / sum(n) AS brier FROM rb GROUP BY domain),
    ba AS (SELECT domain, max(n) / sum(n) AS baseline FROM (SELECT domain, y, count(*) AS n FROM held GROUP BY ALL) GROUP BY domain),
    mc AS (SELECT domain, y, count(*) AS n FROM h WHERE NOT held GROUP BY ALL), mg AS (SELECT d.domain, k.y, coalesce(n, 0) + 1.0 AS n FROM (SELECT DISTINCT domain FROM h) d, (SELECT unnest(range(5)) AS y) k LEFT JOIN mc ON mc.domain = d.domain AND mc.y = k.y),
    ms AS (SELECT domain, list(n ORDER BY y) AS ns, sum(n) AS t FROM mg GROUP BY domain), mb AS (SELECT domain, avg(list_sum(list_transform(range(5), lambda i: pow(ns[i + 1] / t - CASE WHEN i = y THEN 1 ELSE 0 END, 2)))) AS marginal FROM held JOIN ms USING (domain) GROUP BY domain),
    al AS (SELECT rp.*, baseline, marginal, adaptive, p95 FROM rp JOIN ba USING (domain) JOIN mb USING (domain) JOIN ad USING (domain) JOIN (SELECT domain, p95 FROM fl) USING (domain))
    {' UNION ALL '.join(f"SELECT domain, '{g}' AS gate, round({v}, 6) AS value, {float(x)}::DOUBLE AS {chr(34)}limit{chr(34)}, {v} {op} {x} AS passed, {str(g == 'gate_is_testable').lower()} AS advisory FROM al" for g, v, x, op in GATES)}""")
def g_release_gates(spark, sf_dir):
    # five reports read the answers: they are scored once
    s = stage(splits.hash_holdout(views.event_scored(spark, sf_dir), "case_id", 0.3), "scored")
    train, test = s.where("not held_out"), s.where("held_out")
    report = K.calibration_report(test, ["domain"]).join(K.per_question(test, ["domain"]).select("domain", "baseline"), "domain")
    marginal = K.marginal_scores(train, test, ["domain"]).select("domain", F.col("brier").alias("marginal_brier"))
    floor = K.noise_floor(test, ["domain"]).select("domain", F.col("p95").alias("floor_p95"))
    return rounded(gates.check_gates(report.join(marginal, "domain").join(floor, "domain"), ["domain"]), "value")


# ---- decisions ----------------------------------------------------------------------------------


@register(f"""WITH {scored_sql()} SELECT case_id, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS selected, round(1 + list_sum(list_transform(probs, lambda p: p * ln(p))) / ln(len(probs)), 6) AS entropy_confidence,
    round(list_sort(probs)[5] - list_sort(probs)[4], 6) AS margin_confidence, round((list_max(probs) - 0.2) / 0.8, 6) AS max_confidence, round(nll, 6) AS nll, round(brier, 6) AS brier FROM sc""")
def d6_confidence(spark, sf_dir):
    s = views.event_scored(spark, sf_dir)
    return s.select("case_id", V.argmax("probs").alias("selected"), *[F.round(V.choice_confidence("probs", m), 6).alias(f"{m}_confidence") for m in ("entropy", "margin", "max")], F.round(V.log_loss("probs", "y"), 6).alias("nll"), F.round(V.brier("probs", "y"), 6).alias("brier"))


@register(f"""WITH {scored_sql()}, m AS (SELECT *, list_sum(list_transform(range(5), lambda i: i * probs[i + 1])) AS mean FROM sc)
    SELECT case_id, round(mean, 6) AS score, round(1 - sqrt(list_sum(list_transform(range(5), lambda i: probs[i + 1] * pow(i - mean, 2)))) / 2, 6) AS confidence FROM m""")
def d7_score_confidence(spark, sf_dir):
    s = views.event_scored(spark, sf_dir)
    anchors = F.transform("probs", lambda p, i: i.cast("double"))
    return s.select("case_id", F.round(V.expectation("probs", anchors), 6).alias("score"), F.round(V.score_confidence("probs", anchors), 6).alias("confidence"))


@register(f"""WITH {scored_sql()}, r AS (SELECT case_id, probs, list_sort(list_transform(list_grade_up(probs, 'DESC')[1:3], lambda i: i - 1)) AS s FROM sc)
    SELECT case_id, array_to_string(s, ',') AS shown, round(list_sum(list_transform(s, lambda i: probs[i + 1])), 6) AS mass FROM r""")
def d9_present_top_k(spark, sf_dir):
    out = J.present_top_k(views.event_scored(spark, sf_dir), 3)
    return out.select("case_id", F.array_join(F.col("shown").cast("array<string>"), ",").alias("shown"), F.round("mass", 6).alias("mass"))


@register(f"""WITH {scored_sql('a')}, {scored_sql('b', 'v', 0.6)}, j AS (SELECT a.domain, CASE WHEN 1 + list_sum(list_transform(a.probs, lambda p: p * ln(p))) / ln(5) < 0.2 THEN 1 ELSE 0 END AS esc, a.correct AS ca, b.correct AS cb FROM a JOIN b USING (case_id))
    SELECT domain, count(*) AS n, CAST(sum(esc) AS BIGINT) AS escalated, round(avg(CASE WHEN esc = 1 THEN cb ELSE ca END), 6) AS accuracy FROM j GROUP BY domain""")
def d17_escalation(spark, sf_dir):
    own, premium = views.event_scored(spark, sf_dir), views.event_scored(spark, sf_dir, "v", 0.6)
    out = K.with_confidence(J.escalate(own, premium, ["case_id"], 0.2))
    return rounded(out.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if("escalated").alias("escalated"), F.avg("correct").alias("accuracy")), "accuracy")


# ---- comparisons ---------------------------------------------------------------------------------


@register(f"""WITH {scored_sql('a')}, {scored_sql('b', 'v', 0.6)}, u AS (SELECT 'a' AS system, domain AS slice, case_id, correct FROM a UNION ALL SELECT 'b', domain, case_id, correct FROM b WHERE {draw_sql('gap', 'case_id')} >= 0.2),
    c AS (SELECT case_id FROM u GROUP BY case_id HAVING count(DISTINCT system) = 2) SELECT system, slice, count(*) AS n, round(avg(correct), 6) AS accuracy FROM u WHERE case_id IN (FROM c) GROUP BY ALL""")
def j2_compare_systems(spark, sf_dir):
    """The second system left a drawn fifth unanswered, so only the common cases count."""

    def rows(name, df):
        return K.with_confidence(df).select(F.lit(name).alias("system"), F.col("domain").alias("slice"), "case_id", "correct")

    missing = views.event_scored(spark, sf_dir, "v", 0.6).where(V.uniform("case_id", "gap") >= 0.2)
    return rounded(J.compare_systems(rows("a", views.event_scored(spark, sf_dir)).unionByName(rows("b", missing))), "accuracy")


PAIR = f"WITH {scored_sql('a')}, {scored_sql('b', 'v', 0.6)}, j AS (SELECT a.domain, a.case_id, a.probs AS p, b.probs AS q, a.correct AS ca, b.correct AS cb, list_position(a.probs, list_max(a.probs)) AS x, list_position(b.probs, list_max(b.probs)) AS z, a.y FROM a JOIN b USING (case_id))"


@register(f"{PAIR} SELECT domain, count(*) AS n, round(avg(CASE WHEN x = z THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(avg(list_max(p)), 6) AS our_confidence, round(avg(list_max(q)), 6) AS their_confidence FROM j GROUP BY domain")
def j3_migration_diff(spark, sf_dir):
    ours, theirs = (views.event_scored(spark, sf_dir, s, k).withColumns({"decision": V.argmax("probs"), "confidence": F.array_max("probs")}) for s, k in (("l", 1.2), ("v", 0.6)))
    return rounded(J.migration_diff(ours, theirs, ["domain"]), "agreement", "our_confidence", "their_confidence")


@register(f"{PAIR} SELECT count(*) AS n, count_if(x - 1 = y) AS ours_right, count_if(z - 1 = y) AS theirs_right, count_if(x - 1 <> y AND z - 1 <> y) AS both_wrong FROM j WHERE x <> z")
def j4_migration_verdict(spark, sf_dir):
    s = views.event_scored(spark, sf_dir)
    ours, theirs = (views.event_scored(spark, sf_dir, a, k).withColumn("decision", V.argmax("probs")) for a, k in (("l", 1.2), ("v", 0.6)))
    return J.migration_verdict(ours, theirs, s.select("case_id", "qid", F.col("y").alias("truth")))


@register(f"""{PAIR} SELECT domain, count(*) AS n, round(avg(CASE WHEN x <> z THEN 1.0 ELSE 0.0 END), 6) AS flip_rate, round(avg(list_sum(list_transform(range(5), lambda i: abs(p[i + 1] - q[i + 1]))) / 2), 6) AS drift,
    round(avg(ca), 6) AS anchor_accuracy, round(avg(cb), 6) AS variant_accuracy, round(avg(ca) - avg(cb), 6) AS drop FROM j GROUP BY domain""")
def r6_pair_same(spark, sf_dir):
    return rounded(J.pair_same(views.paired(spark, sf_dir), ["domain"]), "flip_rate", "drift", "anchor_accuracy", "variant_accuracy", "drop")


@register("""WITH e AS (SELECT user_id, count(*) AS calls, count(*) - 1 AS hits, sum(length(props)) AS billed, arg_min(length(props), (ts, event_id)) AS computed FROM events GROUP BY user_id) SELECT user_id, calls, hits, CAST(billed AS BIGINT) AS billed, CAST(computed AS INTEGER) AS computed FROM e""")
def l14_cache_accounting(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").withColumn("tokens", F.length("props"))
    return J.cache_accounting(events, "user_id", "ts", "tokens", "event_id")


@register("""SELECT event_type, count(*) AS requests, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.99), 6) AS p99, round(sum(value) / 3.6e6 * 0.8 / sum(length(props)) * 1e6, 6) AS usd_per_mtok FROM events GROUP BY event_type""")
def l15_serving_cost(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").withColumn("tokens", F.length("props"))
    return rounded(J.serving_cost(events, ["event_type"], "value", "tokens", 0.8), "p50", "p99", "usd_per_mtok")


# ---- cases and splits ------------------------------------------------------------------------------


@register(f"""WITH a AS (SELECT l_orderkey AS item, l_linenumber AS rater, CAST(floor(l_quantity) AS BIGINT) % 5 AS v FROM lineitem), g AS (SELECT item, list(v ORDER BY rater, v) AS vs FROM a GROUP BY item HAVING count(*) >= 2)
    SELECT item, CAST(len(vs) AS INTEGER) AS raters, array_to_string(list_transform(range(5), lambda k: CAST(len(list_filter(vs, lambda x: x = k)) AS VARCHAR)), ',') AS votes, CAST(vs[CAST(floor({draw_sql('rater', 'item')} * len(vs)) AS BIGINT) + 1] AS INTEGER) AS y FROM g""")
def c6_group_annotators(spark, sf_dir):
    got = C.group_annotators(views.annotators(spark, sf_dir), "item", "rater", F.col("rating"), 5)
    votes = F.transform("distribution", lambda d: F.round(d * F.col("raters")).cast("int").cast("string"))
    return got.select("item", "raters", F.array_join(votes, ",").alias("votes"), "y")


@register(f"""WITH a AS (SELECT l_orderkey AS item, l_linenumber AS rater, CAST(floor(l_quantity) AS BIGINT) % 5 AS v FROM lineitem),
    d AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY {u_sql("'half|' || CAST(item AS VARCHAR) || '|' || CAST(rater AS VARCHAR)")}, rater) AS r, count(*) OVER (PARTITION BY item) AS n FROM (SELECT DISTINCT ON (item, rater) * FROM a ORDER BY item, rater, v)),
    m AS (SELECT item, floor(avg(v) FILTER (r % 2 = 0) + 0.5) AS h0, floor(avg(v) FILTER (r % 2 = 1) + 0.5) AS h1 FROM d WHERE n >= 4 GROUP BY item) SELECT count(*) AS n, round(avg(CASE WHEN h0 = h1 THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM m""")
def l3_split_half(spark, sf_dir):
    once = views.annotators(spark, sf_dir).groupBy("item", "rater").agg(F.min("rating").alias("rating"))
    return rounded(J.split_half(once, "item", "rater", "rating"), "agreement")


@register("""WITH o AS (SELECT list_sort(list(DISTINCT o_orderpriority)) AS ops FROM orders) SELECT o_orderstatus AS split, list_position(ops, o_orderpriority) - 1 AS y, count(*) AS n FROM orders, o GROUP BY ALL""")
def c2_text_choice(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    got = C.text_choice_cases(orders, "o_orderpriority", "o_orderpriority", "o_orderstatus")
    return got.groupBy(F.col("o_orderstatus").alias("split"), "y").agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT o_orderkey, {draw_sql('holdout', 'o_orderkey')} < 0.2 AS held_out FROM orders")
def p1_hash_holdout(spark, sf_dir):
    return splits.hash_holdout(views.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@register(f"SELECT split, count(*) AS n FROM (SELECT CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.9 THEN 'eval' ELSE 'calibration' END AS split FROM (SELECT {draw_sql('split', 'o_orderkey')} * 1.0 AS u FROM orders)) GROUP BY split")
def p2_split_named(spark, sf_dir):
    got = splits.split_named(views.table(spark, sf_dir, "orders"), "o_orderkey", {"train": 0.7, "eval": 0.2, "calibration": 0.1})
    return got.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {draw_sql('sample', 'o_orderkey')}, o_orderkey) <= 50")
def p7_sample_per_slice(spark, sf_dir):
    return splits.sample_per_slice(views.table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 50)


@register(f"SELECT o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY {draw_sql('balance', 'o_orderkey')}, o_orderkey) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))")
def c17_balance(spark, sf_dir):
    return splits.balance_by_label(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@register("SELECT c.conv_id, c.turn FROM conversations c WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE trim(text) IN (SELECT trim(text) FROM documents WHERE text IS NOT NULL))")
def p5_exclude_texts(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations")
    return splits.exclude_texts(turns, views.table(spark, sf_dir, "documents").select("text"), "text", "conv_id").select("conv_id", "turn")


# ---- text and retrieval ------------------------------------------------------------------------------


@register(f"WITH {tokens_sql('t', 'documents', 'doc_id')} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY token")
def x1_tokens(spark, sf_dir):
    # a document is one row, so a token's rows are its documents
    return token_counts(views.table(spark, sf_dir, "documents"), "text", ["doc_id"]).groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@register(f"""WITH o AS (SELECT item_id AS idx, text FROM benchmark), {tokens_sql('t', 'o', 'idx')}, {tokens_sql('q', 'documents', 'doc_id')},
    tf AS (SELECT idx, token, count(*) AS tf FROM t GROUP BY ALL), sz AS (SELECT idx, count(*) AS sz FROM t GROUP BY idx), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
    st AS (SELECT (SELECT count(*) FROM o) AS n, (SELECT count(*) FROM t) / (SELECT count(*) FROM o) AS av),
    s AS (SELECT doc_id AS qid, idx, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sz / av))), 9) AS score FROM (SELECT DISTINCT doc_id, token FROM q) JOIN tf USING (token) JOIN sz USING (idx) JOIN df USING (token), st GROUP BY ALL),
    a AS (SELECT doc_id AS qid, o.idx, s.score FROM documents, o LEFT JOIN s ON s.qid = doc_id AND s.idx = o.idx),
    r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, idx) AS rank, idx, score FROM a)
    SELECT qid, CAST(rank AS INTEGER) AS rank, idx, round(score, 6) AS score FROM r WHERE rank <= 5""")
def x5_bm25_shortlist(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), "text")
    return rounded(retrieval.bm25_shortlist(docs, views.items(spark, sf_dir), 5), "score")


@register(f"""WITH o AS (SELECT item_id AS idx, text FROM benchmark), {tokens_sql('t', 'o', 'idx')}, {tokens_sql('q', 'documents', 'doc_id')}, c AS (SELECT doc_id, token, count(*) AS n FROM q GROUP BY ALL), d AS (SELECT DISTINCT idx, token FROM t), z AS (SELECT idx, count(*) AS z FROM d GROUP BY idx)
    SELECT doc_id AS case_id, idx, round(sum(ln(1 + n) * ln(1 + length(token))) / sqrt(max(z)), 6) AS score FROM c JOIN d USING (token) JOIN z USING (idx) GROUP BY ALL""")
def x3_lexical_scores(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "text")
    return rounded(retrieval.lexical_scores(docs, views.items(spark, sf_dir)), "score")


@register("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS s FROM v), u AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN s > 0 THEN x / s ELSE 0 END) AS e FROM n),
    j AS (SELECT q.vec_id AS qid, o.vec_id AS idx, round(list_dot_product(q.e, o.e), 9) AS score FROM u q, u o WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS rank FROM j) SELECT qid, CAST(rank AS INTEGER) AS rank, idx, round(score, 6) AS score FROM r WHERE rank <= 10""")
def x7_vector_shortlist(spark, sf_dir):
    v = views.table(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vec"))
    return rounded(retrieval.vector_shortlist(queries, v.select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("vec")), 10), "score")


@register("""WITH p AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+|[0-9]+')) AS piece FROM conversations) SELECT piece, count(*) AS n FROM p GROUP BY piece HAVING count(*) >= 2""")
def x13_piece_counts(spark, sf_dir):
    return retrieval.piece_counts(views.table(spark, sf_dir, "conversations"), "text", 2, "[A-Za-z]+|[0-9]+")


# ---- evidence ------------------------------------------------------------------------------------------


@register("""WITH p AS (SELECT doc_id, length(regexp_extract(text, '^[ \\t\\n\\r\\f\\v]*')) AS lead, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+[ \\t\\n\\r\\f\\v]*') AS ps FROM documents), u AS (SELECT doc_id, lead, unnest(ps) AS piece, unnest(range(len(ps))) AS w FROM p),
    s AS (SELECT doc_id, w, CAST(lead + sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY w) - length(piece) AS BIGINT) AS start, regexp_extract(piece, '^[^ \\t\\n\\r\\f\\v]+') AS word FROM u) SELECT doc_id, w, start, start + length(word) AS "end", sha256(word) AS word FROM s""")
def e1_word_spans(spark, sf_dir):
    words = E.word_spans(views.table(spark, sf_dir, "documents"), "text", ["doc_id"], together=True)
    return words.select("doc_id", F.col("w").cast("long").alias("w"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.sha2("word", 256).alias("word"))


MARKS = f"w AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY p) - 1 AS w FROM (SELECT conv_id, turn, unnest(range(1, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) + 1)) AS p FROM conversations)), m AS (SELECT *, {u_sql(chr(39) + 'g|' + chr(39) + ' || conv_id || chr(45) || turn || chr(45) || w')} < 0.3 AS g, {u_sql(chr(39) + 'p|' + chr(39) + ' || conv_id || chr(45) || turn || chr(45) || w')} < 0.3 AS p FROM w)"


def _marks(spark, sf_dir):
    words = E.word_spans(views.table(spark, sf_dir, "conversations"), "text", ["conv_id", "turn"])
    key = F.concat_ws("-", "conv_id", "turn", "w")
    return words.withColumns({"gold": V.uniform(key, "g") < 0.3, "predicted": V.uniform(key, "p") < 0.3})


@register(f"""WITH {MARKS}, c AS (SELECT conv_id, turn, count_if(g AND p) AS b, count_if(g) AS g, count_if(p) AS p FROM m GROUP BY ALL), r AS (SELECT conv_id, turn, CASE WHEN p = 0 THEN 0 ELSE b / p END AS pr, CASE WHEN g = 0 THEN 0 ELSE b / g END AS re FROM c)
    SELECT conv_id, turn, round(pr, 6) AS "precision", round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM r""")
def e6_token_prf(spark, sf_dir):
    return rounded(E.token_prf(_marks(spark, sf_dir), ["conv_id", "turn"]), "precision", "recall", "f1")


def _runs(mark: str) -> str:
    return f"{mark}r AS (SELECT conv_id, turn, min(w) AS a, max(w) AS b FROM (SELECT *, w - row_number() OVER (PARTITION BY conv_id, turn ORDER BY w) AS k FROM m WHERE {mark}) GROUP BY conv_id, turn, k)"


@register(f"""WITH {MARKS}, {_runs('g')}, {_runs('p')}, o AS (SELECT gr.conv_id, gr.turn, gr.a AS ga, pr.a AS pa FROM gr JOIN pr ON gr.conv_id = pr.conv_id AND gr.turn = pr.turn WHERE least(gr.b, pr.b) - greatest(gr.a, pr.a) + 1 > 0 AND (least(gr.b, pr.b) - greatest(gr.a, pr.a) + 1) / (greatest(gr.b, pr.b) - least(gr.a, pr.a) + 1) >= 0.5),
    n AS (SELECT conv_id, turn, sum(g) AS g, sum(p) AS p FROM (SELECT conv_id, turn, 1 AS g, 0 AS p FROM gr UNION ALL SELECT conv_id, turn, 0, 1 FROM pr) GROUP BY ALL), h AS (SELECT conv_id, turn, count(DISTINCT ga) AS gh, count(DISTINCT pa) AS ph FROM o GROUP BY ALL),
    f AS (SELECT n.conv_id, n.turn, CASE WHEN g = 0 THEN 0 ELSE coalesce(gh, 0) / g END AS r, CASE WHEN p = 0 THEN 0 ELSE coalesce(ph, 0) / p END AS q FROM n LEFT JOIN h ON h.conv_id = n.conv_id AND h.turn = n.turn)
    SELECT conv_id, turn, round(CASE WHEN r + q = 0 THEN 0 ELSE 2 * r * q / (r + q) END, 6) AS iou_f1 FROM f""")
def e7_iou_f1(spark, sf_dir):
    return rounded(E.iou_f1(_marks(spark, sf_dir), ["conv_id", "turn"]), "iou_f1")


@register(f"""WITH x AS (SELECT conv_id, turn, length(regexp_extract(text, '^[ \\t\\n\\r\\f\\v]*')) AS lead, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+[ \\t\\n\\r\\f\\v]*') AS ps FROM conversations), u AS (SELECT conv_id, turn, lead, unnest(ps) AS piece, unnest(range(len(ps))) AS w FROM x),
    s AS (SELECT conv_id, turn, w, lead + sum(length(piece)) OVER (PARTITION BY conv_id, turn ORDER BY w) - length(piece) AS a, length(regexp_extract(piece, '^[^ \\t\\n\\r\\f\\v]+')) AS n, {u_sql("'s|' || conv_id || '-' || turn || '-' || w")} AS score FROM u),
    k AS (SELECT *, w - row_number() OVER (PARTITION BY conv_id, turn ORDER BY w) AS g FROM s WHERE score >= 0.5)
    SELECT conv_id, turn, CAST(min(a) AS BIGINT) AS start, CAST(max(a + n) AS BIGINT) AS "end", round(least(1.0, max(score)), 6) AS score FROM k GROUP BY conv_id, turn, g""")
def e3_merge_spans(spark, sf_dir):
    """Words are tokens, so neighbours over the threshold have white space alone between them."""
    key = ["conv_id", "turn"]
    words = E.word_spans(views.table(spark, sf_dir, "conversations"), "text", key)
    # a word's last character before it that isn't white space is the end of the word before
    ink = F.lag("end", 1, 0).over(Window.partitionBy(*key).orderBy("w"))
    tokens = words.select(*key, "start", "end", V.uniform(F.concat_ws("-", *key, "w"), "s").alias("score"), ink.alias("ink"))
    out = E.merge_spans(tokens, key, ink="ink")
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("start", "end")}), "score")


# ---- streaming twins -------------------------------------------------------------------------------------


@register(f"""WITH {scored_sql()}, b AS (SELECT date_trunc('day', ts) AS start, bin, count(*) AS n, sum(correct - conf) AS gap FROM sc GROUP BY ALL)
    SELECT start, CAST(sum(n) AS BIGINT) AS n, round(sum(abs(gap)) / sum(n), 6) AS ece, sum(abs(gap)) / sum(n) > 0.05 AS alert FROM b GROUP BY start""")
def st4_rolling_calibration(spark, sf_dir):
    return rounded(monitor.window_ece(monitor.rolling_bins(views.event_scored(spark, sf_dir))), "ece")


@register("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS calls, CAST(sum(length(props)) AS BIGINT) AS tokens FROM s GROUP BY user_id, s""")
def st5_session_cost(spark, sf_dir):
    return monitor.session_cost(views.table(spark, sf_dir, "events").withColumn("n", F.length("props")), "user_id", "ts", "n")


@register("SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS admitted FROM events")
def st2_window_admission(spark, sf_dir):
    return monitor.admit(views.table(spark, sf_dir, "events"), "user_id", "ts", 2, "1 day").select("event_id", "admitted")
