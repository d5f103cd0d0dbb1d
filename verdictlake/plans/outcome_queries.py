"""Registered queries over outcome reports, gates, splits, lexical decisions, output of answers and scans of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import bootstrap as B
from ..operators import calibration as K
from ..operators import cases as C
from ..operators import compare as J
from ..operators import evidence as E
from ..operators import faithful as H
from ..operators import gates, loaders, retrieval, serving, splits, teacher, variants
from ..operators import outcomes as O
from ..sources.shared import stage
from . import views
from .catalog import HALVES, MARKS, _fit_sql, floor_sql
from .registry import draw_sql, register, rounded, scored_sql, tokens_sql, u_sql

ECE = "rp AS (SELECT domain, sum(n) AS n, sum(abs(c - f)) / sum(n) AS ece FROM (SELECT domain, bin, count(*) AS n, sum(conf) AS f, sum(correct) AS c FROM {source} GROUP BY ALL) GROUP BY domain)"

# ---- suites and tasks -----------------------------------------------------------------------


def _expected(spark, sf_dir):
    """Labels come for the events of a value above 20."""
    s = views.event_scored(spark, sf_dir)
    worth = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("case_id"), "value", F.length("props").alias("tokens"))
    return s, worth


@register(f"WITH {scored_sql()} SELECT case_id, CASE WHEN value > 20 THEN CAST(y AS INTEGER) END AS y, CASE WHEN value > 20 THEN correct END AS correct FROM sc JOIN events ON event_id = case_id")
def j1_score_join(spark, sf_dir):
    s, worth = _expected(spark, sf_dir)
    known = s.join(worth.where("value > 20"), "case_id").select("case_id", "qid", "y")
    return O.score_join(s.select("case_id", "qid", "probs"), known, ["case_id", "qid"]).select("case_id", "y", "correct")


@register(f"""WITH {scored_sql()}, c AS (SELECT domain, user_id % 3 AS q, y, count(*) AS n FROM sc GROUP BY ALL), e AS (SELECT domain, q, max(n) AS top, sum(n) AS n FROM c GROUP BY ALL)
    SELECT domain, CAST(sum(n) AS BIGINT) AS n, round(sum(top) / sum(n), 6) AS baseline FROM e GROUP BY domain""")
def k13_marginal_accuracy(spark, sf_dir):
    s = views.event_scored(spark, sf_dir).withColumn("question", F.col("user_id") % 3)
    return rounded(O.marginal_accuracy(s, ["domain"], "question"), "baseline")


@register(f"""WITH {scored_sql()}, s AS (SELECT domain, sc.user_id % 3 AS q, CASE WHEN value > 20 THEN y END AS y, correct, value, length(props) AS t FROM sc JOIN events ON event_id = case_id),
    k AS (SELECT domain, count(*) AS n_cases, round(quantile_disc(value, 0.5), 6) AS latency_p50, round(quantile_disc(value, 0.99), 6) AS latency_p99, round(avg(t), 6) AS mean_tokens FROM s GROUP BY domain),
    c AS (SELECT domain, q, y, count(*) AS n, sum(CASE WHEN y IS NOT NULL THEN correct END) AS r FROM s GROUP BY ALL),
    e AS (SELECT domain, q, sum(n) AS asked, sum(n) FILTER (y IS NOT NULL) AS n, sum(r) AS r, max(n) FILTER (y IS NOT NULL) AS top FROM c GROUP BY ALL)
    SELECT domain, max(n_cases) AS n_cases, max(latency_p50) AS latency_p50, max(latency_p99) AS latency_p99, max(mean_tokens) AS mean_tokens, CAST(sum(asked) AS BIGINT) AS n_questions, round(sum(r) / sum(n), 6) AS accuracy, round(sum(top) / sum(n), 6) AS baseline, round(min((r - top) / n), 6) AS worst_lift
    FROM e JOIN k USING (domain) GROUP BY domain""")
def k17_suite_summary(spark, sf_dir):
    s, worth = _expected(spark, sf_dir)
    rows = s.join(worth, "case_id").withColumns({"y": F.when(F.col("value") > 20, F.col("y")), "latency": F.col("value"), "question": F.col("user_id") % 3})
    return rounded(O.summarize(rows, rows, ["domain"], "question"), "latency_p50", "latency_p99", "mean_tokens", "accuracy", "baseline", "worst_lift")


@register(f"WITH {scored_sql()}, {ECE.format(source='sc')}, {floor_sql('sc')} SELECT domain, round(ece, 6) AS ece, round(p95, 6) AS floor_p95, ece > p95 AS distinguishable FROM rp JOIN fl USING (domain)")
def k9_distinguishable(spark, sf_dir):
    s = views.event_scored(spark, sf_dir)
    bins = K.reliability_bins(s, ["domain"], spine=False)
    report = K.ece(bins, ["domain"]).select("domain", "ece")
    return rounded(O.distinguishable(report, K.noise_floor(s, ["domain"]), ["domain"]), "ece", "floor_p95")


@register("""WITH c AS (SELECT l_returnflag AS epoch, l_orderkey, avg(l_discount) AS l FROM lineitem GROUP BY ALL), e AS (SELECT epoch, avg(l) AS loss FROM c GROUP BY epoch) SELECT epoch, round(loss, 6) AS loss, epoch = (SELECT arg_min(epoch, (loss, epoch)) FROM e) AS kept FROM e""")
def k22_validation_loss(spark, sf_dir):
    """Return flags stand for epochs, orders for cases, discounts for losses of questions."""
    li = views.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("epoch"), "l_orderkey", "l_discount")
    return rounded(O.validation_loss(li, "epoch", "l_orderkey", "l_discount"), "loss")


@register(f"WITH {scored_sql()} SELECT domain, round((ln(5) - avg(nll)) / (ln(5) + 0.92 * ln(0.92) + 4 * 0.02 * ln(0.02)), 6) AS closed FROM sc GROUP BY domain")
def k23_gap_closed(spark, sf_dir):
    out = K.with_confidence(views.event_scored(spark, sf_dir)).groupBy("domain").agg(F.avg("nll").alias("nll"))
    return out.select("domain", F.round(O.gap_closed(F.col("nll"), 0.1, 5), 6).alias("closed"))


@register(f"""WITH {scored_sql()}, a AS (SELECT sc.*, value FROM sc JOIN events ON event_id = case_id), k AS (SELECT * FROM a WHERE value > 10),
    b AS (SELECT domain, bin, count(*) AS n, sum(conf) AS f, sum(correct) AS c, sum(nll) AS l, sum(brier) AS q FROM k GROUP BY ALL),
    r AS (SELECT domain, CAST(sum(n) AS BIGINT) AS n, round(sum(c) / sum(n), 6) AS accuracy, 0.2 AS chance, round(sum(f) / sum(n), 6) AS mean_confidence, round(sum(l) / sum(n), 6) AS nll, round(sum(q) / sum(n), 6) AS brier, round(sum(abs(c - f)) / sum(n), 6) AS ece FROM b GROUP BY domain),
    m AS (SELECT domain, round(max(n) / sum(n), 6) AS majority FROM (SELECT domain, y, count(*) AS n FROM k GROUP BY ALL) GROUP BY domain), z AS (SELECT domain, count_if(value <= 10) AS failed FROM a GROUP BY domain)
    SELECT domain, failed, n, accuracy, CAST(chance AS DOUBLE) AS chance, mean_confidence, nll, brier, ece, majority FROM z JOIN r USING (domain) JOIN m USING (domain)""")
def j7_task_score(spark, sf_dir):
    """Answers are unscaled; those of events of a value up to 10 came without mass."""
    s, worth = _expected(spark, sf_dir)
    answers = s.join(worth, "case_id").withColumn("probs", F.transform("probs", lambda p: F.when(F.col("value") > 10, p * 4).otherwise(0.0)))
    return rounded(O.task_score(answers, ["domain"]), "accuracy", "chance", "mean_confidence", "nll", "brier", "ece", "majority")


def _heads(salt: str) -> str:
    k = "CAST(i AS VARCHAR) || '|' || CAST(event_id AS VARCHAR) || '|' || CAST(h AS VARCHAR)"
    return f"list_transform(range(3), lambda i: {u_sql(chr(39) + salt + '|' + chr(39) + ' || ' + k)})"


@register(f"""WITH {scored_sql()}, t AS (SELECT event_id AS case_id, h, user_id % 3 AS y, {_heads('target')} AS w FROM events, (SELECT unnest([0, 1, 2]) AS h)),
    q AS (SELECT case_id, h, y, list_transform(w, lambda x: x / list_sum(w)) AS p FROM t), g AS (SELECT case_id, h, list_max(p) AS tp, list_position(p, list_max(p)) - 1 = y AS hit FROM q),
    s AS (SELECT sc.case_id, sc.y, list_position(probs, list_max(probs)) - 1 AS op, list_max(probs) AS p FROM sc),
    r AS (SELECT s.y, CASE WHEN s.op = s.y THEN 1.0 ELSE 0.0 END AS op_ok, CASE WHEN coalesce(o.hit, false) THEN 1.0 ELSE 0.0 END AS target_ok, CASE WHEN s.op = s.y AND coalesce(d.hit, true) THEN 1.0 ELSE 0.0 END AS success, round(s.p * coalesce(d.tp, 1.0), 9) AS conf
      FROM s LEFT JOIN g o ON o.case_id = s.case_id AND o.h = s.y LEFT JOIN g d ON d.case_id = s.case_id AND d.h = s.op),
    u AS (SELECT *, least(floor(round(greatest(conf, 1 - conf), 9) / (1.0::DOUBLE / 15)), 14) AS bin, CASE WHEN conf > 0.5 THEN success ELSE 1 - success END - greatest(conf, 1 - conf) AS gap, unnest(['op' || y, NULL]) AS slice FROM r),
    b AS (SELECT slice, bin, count(*) AS n, sum(gap) AS gap, sum(op_ok) AS a, sum(target_ok) AS t, sum(success) AS s, sum(conf) AS c FROM u GROUP BY ALL)
    SELECT slice, CAST(sum(n) AS BIGINT) AS n, round(sum(a) / sum(n), 6) AS operation_accuracy, round(sum(t) / sum(n), 6) AS target_accuracy, round(sum(s) / sum(n), 6) AS step_success, round(sum(c) / sum(n), 6) AS mean_confidence, round(sum(abs(gap)) / sum(n), 6) AS ece FROM b GROUP BY slice""")
def j8_step_score(spark, sf_dir):
    """The event type is the operation; three of the five have a target head."""
    s = views.event_scored(spark, sf_dir)
    ops = s.select("case_id", F.transform("labels", lambda x, i: F.concat(F.lit("op"), i.cast("string"))).alias("ops"), "probs", "y")
    heads = s.select("case_id", (F.col("user_id") % 3).cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("h"))
    weight = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: V.uniform(F.concat_ws("|", i, "case_id", "h"), "target"))
    targets = heads.select("case_id", F.concat(F.lit("op"), "h").alias("op"), V.normalize(weight).alias("probs"), "y")
    return rounded(O.step_score(ops, targets), "operation_accuracy", "target_accuracy", "step_success", "mean_confidence", "ece")


@register(f"""WITH {scored_sql()}, r AS (SELECT case_id, y, probs, list_grade_up(probs, 'DESC') AS g, ty FROM sc, sc_t ORDER BY case_id LIMIT 25)
    SELECT case_id, ty[g[1]] AS first, round(probs[g[1]], 6) AS p_first, ty[g[2]] AS second, round(probs[g[2]], 6) AS p_second, ty[y + 1] AS truth, g[1] - 1 = y AS hit FROM r""")
def j15_inspect_answers(spark, sf_dir):
    return rounded(O.inspect_answers(views.event_scored(spark, sf_dir), 25), "p_first", "p_second")


PAIR = f"WITH {scored_sql('a')}, {scored_sql('b', 'v', 0.6)}, j AS (SELECT a.domain, a.case_id, a.probs AS p, b.probs AS q, a.correct AS ca, b.correct AS cb, list_position(a.probs, list_max(a.probs)) AS x, list_position(b.probs, list_max(b.probs)) AS z FROM a JOIN b USING (case_id))"
SAME = "count(*) AS n, round(avg(CASE WHEN x <> z THEN 1.0 ELSE 0.0 END), 6) AS flip_rate, round(avg(list_sum(list_transform(range(5), lambda i: abs(p[i + 1] - q[i + 1]))) / 2), 6) AS drift, round(avg(ca), 6) AS anchor_accuracy, round(avg(cb), 6) AS variant_accuracy, round(avg(ca) - avg(cb), 6) AS drop"


@register(f"""{PAIR}, g AS (SELECT domain, round(avg(correct), 6) AS guardrail_detection FROM b JOIN events ON event_id = case_id WHERE value > 90 GROUP BY domain), s AS (SELECT domain, {SAME} FROM j GROUP BY domain) SELECT * FROM s LEFT JOIN g USING (domain)""")
def r11_steering(spark, sf_dir):
    """Answers of the second system to events of a value above 90 stand for the guardrail's."""
    watched = views.event_scored(spark, sf_dir, "v", 0.6).join(views.table(spark, sf_dir, "events").where("value > 90").select(F.col("event_id").alias("case_id")), "case_id", "left_semi")
    return rounded(O.steering(views.paired(spark, sf_dir), watched, ["domain"]), "flip_rate", "drift", "anchor_accuracy", "variant_accuracy", "drop", "guardrail_detection")


@register(f"WITH {scored_sql()} SELECT domain, count(*) AS n, round(avg(correct), 6) AS accuracy FROM sc GROUP BY domain")
def r14_accuracy(spark, sf_dir):
    return rounded(O.accuracy(views.event_scored(spark, sf_dir), ["domain"]), "accuracy")


@register(f"""{PAIR}, s AS (SELECT domain, {SAME} FROM j GROUP BY domain) SELECT domain, m.metric AS metric, m.value AS value FROM (SELECT domain, unnest([{', '.join(f"{{'metric': '{c}', 'value': CAST({c} AS DOUBLE)}}" for c in ('n', 'flip_rate', 'drift', 'anchor_accuracy', 'variant_accuracy', 'drop'))}]) AS m FROM s)""")
def r16_floor_metrics(spark, sf_dir):
    return rounded(O.floor_suite(views.paired(spark, sf_dir), ["domain"]), "value")


@register(f"""WITH v AS (SELECT l_orderkey AS item, l_linenumber AS rater, CAST(floor(l_quantity) AS BIGINT) % 5 AS v FROM lineitem), g AS (SELECT item, list(v ORDER BY rater, v) AS vs FROM v GROUP BY item HAVING count(*) >= 2),
    i AS (SELECT item, list_transform(range(5), lambda k: len(list_filter(vs, lambda x: x = k))) AS cs, vs[CAST(floor({draw_sql('rater', 'item')} * len(vs)) AS BIGINT) + 1] AS y, 'q' || (item % 3) AS question FROM g),
    pc AS (SELECT y, count(*) AS n FROM i GROUP BY y), pr AS (SELECT list_transform(range(5), lambda k: coalesce(list_sum(list_transform(list_filter(ls, lambda s: s.y = k), lambda s: s.n)), 0) / total) AS pr FROM (SELECT list({{'y': y, 'n': n}}) AS ls, sum(n) AS total FROM pc)),
    o AS (SELECT question, y, list_position(cs, list_max(cs)) - 1 AS nv, list_transform(range(5), lambda k: round(cs[k + 1] - CASE WHEN k = y THEN 1 ELSE 0 END + 2.0::DOUBLE * pr[k + 1], 9)) AS os FROM i, pr),
    c AS (SELECT question, y, count(*) AS n, count_if(nv = y) AS nv, count_if(list_position(os, list_max(os)) - 1 = y) AS lo FROM o GROUP BY ALL),
    e AS (SELECT question, max(n) / sum(n) AS m, sum(nv) / sum(n) AS nv, sum(lo) / sum(n) AS lo FROM c GROUP BY question), b AS (SELECT unnest([question, NULL]) AS question, m, nv, lo FROM e)
    SELECT question, round(avg(m), 6) AS marginal, round(avg(nv), 6) AS naive, round(avg(lo), 6) AS loo, round(avg(nv) - avg(m), 6) AS naive_lift, round(avg(lo) - avg(m), 6) AS loo_lift FROM b GROUP BY question""")
def l4_ceiling_table(spark, sf_dir):
    """Ratings of order lines; the leave-one-out oracle's prior is the share of each drawn label."""
    items = C.group_annotators(views.annotators(spark, sf_dir), "item", "rater", F.col("rating"), 5).withColumns({"counts": F.transform("distribution", lambda d: F.round(d * F.col("raters")).cast("int")), "question": F.concat(F.lit("q"), F.col("item") % 3)})
    shares = items.groupBy("y").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("_m"), F.sum("n").alias("_t"))
    prior = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0)) / F.col("_t"))
    others = F.zip_with(F.transform("counts", lambda c, i: c - F.when(i == F.col("y"), 1).otherwise(0)), prior, lambda c, p: F.round(c + 2.0 * p, 9))
    oracles = items.crossJoin(F.broadcast(shares)).select("question", "y", V.argmax("distribution").alias("naive"), V.argmax(others).alias("loo"))
    return rounded(O.ceiling_table(oracles), "marginal", "naive", "loo", "naive_lift", "loo_lift")


@register(f"""WITH {MARKS}, h AS (SELECT conv_id, turn, g, unnest([{{'n': 'drawn', 'p': p}}, {{'n': 'every word', 'p': true}}, {{'n': 'first words', 'p': w < 5}}]) AS x FROM m),
    c AS (SELECT conv_id, turn, x.n AS name, count_if(g AND x.p) AS b, count_if(g) AS g, count_if(x.p) AS p, count(*) AS n FROM h GROUP BY ALL), r AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE b / p END AS pr, b / g AS re FROM c WHERE g > 0)
    SELECT name, count(*) AS n, round(avg(pr), 6) AS "precision", round(avg(re), 6) AS recall, round(avg(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END), 6) AS f1, round(avg(p / n), 6) AS highlighted, round(avg(g / n), 6) AS human FROM r GROUP BY name""")
def e10_plausibility_suite(spark, sf_dir):
    key = ["conv_id", "turn"]
    words = E.word_spans(views.table(spark, sf_dir, "conversations"), "text", key)
    at = F.concat_ws("-", "conv_id", "turn", "w")
    out = O.plausibility_suite(words.withColumn("gold", V.uniform(at, "g") < 0.3), key, {"drawn": V.uniform(at, "p") < 0.3, "first words": F.col("w") < 5})
    return rounded(out, "precision", "recall", "f1", "highlighted", "human")


# ---- gates ------------------------------------------------------------------------------------


@register(f"""{PAIR}, x AS (SELECT a.*, user_id % 3 AS q FROM a), c AS (SELECT domain, q, y, count(*) AS n, sum(correct) AS r FROM x GROUP BY ALL), l AS (SELECT domain, q, (sum(r) - max(n)) / sum(n) AS lift FROM c GROUP BY ALL), wl AS (SELECT domain, min(lift) AS worst_lift FROM l GROUP BY domain),
    pb AS (SELECT domain, q, bin, count(*) AS n, sum(conf) AS f, sum(correct) AS c FROM x GROUP BY ALL), pe AS (SELECT domain, q, sum(abs(c - f)) / sum(n) AS ece FROM pb GROUP BY ALL), we AS (SELECT domain, max(ece) AS worst_ece FROM pe GROUP BY domain),
    d AS (SELECT domain, avg(ca) - avg(cb) AS dp FROM j GROUP BY domain), {ECE.format(source='a').replace('rp', 'ra', 1)}, {ECE.format(source='b').replace('rp', 'rb', 1)},
    tk AS (SELECT domain, avg(CASE WHEN list_contains(list_grade_up(q, 'DESC')[1:3], x) THEN 1.0 ELSE 0.0 END) AS rc FROM j GROUP BY domain),
    t AS (SELECT domain, worst_lift, worst_ece, dp, rc, ra.ece - rb.ece AS dl FROM wl JOIN we USING (domain) JOIN tk USING (domain) JOIN d USING (domain) JOIN ra USING (domain) JOIN rb USING (domain))
    SELECT domain, g.gate AS gate, round(g.value, 6) AS value, g.lim AS "limit", g.ok AS passed, g.adv AS advisory FROM (SELECT domain, unnest([{{'gate': 'worst_question_over_baseline', 'value': worst_lift, 'lim': 0.05::DOUBLE, 'ok': worst_lift >= 0.05, 'adv': true}}, {{'gate': 'worst_primitive_workhorse_ece', 'value': worst_ece, 'lim': 0.05::DOUBLE, 'ok': worst_ece <= 0.05, 'adv': true}},
      {{'gate': 'injection_robustness', 'value': dp, 'lim': 0.1::DOUBLE, 'ok': dp <= 0.1, 'adv': true}}, {{'gate': 'quantization_ece_delta', 'value': abs(dl), 'lim': 0.01::DOUBLE, 'ok': abs(dl) <= 0.01, 'adv': false}}, {{'gate': 'recall', 'value': rc, 'lim': 0.99::DOUBLE, 'ok': rc >= 0.99, 'adv': false}}]) AS g FROM t)""")
def g6_slice_gates(spark, sf_dir):
    """Users mod three stand for questions and primitives, the second system for the variant and the other run."""
    s, v = (stage(views.event_scored(spark, sf_dir, a, k), "scored") for a, k in (("l", 1.2), ("v", 0.6)))
    x = s.withColumn("q", F.col("user_id") % 3)
    lift = K.per_question(x, ["domain", "q"]).groupBy("domain").agg(F.min("lift").alias("worst_lift"))
    worst = K.ece(K.reliability_bins(x, ["domain", "q"], spine=False), ["domain", "q"]).groupBy("domain").agg(F.max("ece").alias("worst_ece"))
    role = lambda df, r: df.select(F.col("case_id").alias("pair_id"), "domain", "probs", "y", F.lit(r).alias("role"))
    drop = J.pair_same(role(s, "anchor").unionByName(role(v, "variant")), ["domain"]).select("domain", F.col("drop").alias("injection_drop"))
    ece = lambda df, n: K.ece(K.reliability_bins(df, ["domain"], spine=False), ["domain"]).select("domain", F.col("ece").alias(n))
    # the second system's three likeliest labels are a shortlist, the first system's choice is what it has to hold
    kept = s.select("case_id", "domain", V.argmax("probs").alias("_x")).join(v.select("case_id", V.top_k("probs", 3).alias("_k")), "case_id")
    recall = kept.groupBy("domain").agg(F.avg(F.array_contains("_k", F.col("_x")).cast("double")).alias("recall"))
    rows = lift.join(worst, "domain").join(drop, "domain").join(ece(s, "_a"), "domain").join(ece(v, "_b"), "domain").join(recall, "domain")
    return rounded(gates.slice_gates(rows.withColumn("ece_delta", F.col("_a") - F.col("_b")), ["domain"]), "value")


@register("""WITH r AS (SELECT event_type AS config, user_id AS seed, avg(value) AS loss, avg(value) <= 50 AS ok FROM events GROUP BY ALL), s AS (SELECT config, seed, loss, ok, CASE WHEN ok THEN [] WHEN seed % 2 = 0 THEN ['ece'] ELSE ['ece', 'sample_size'] END AS bl FROM r),
    a AS (SELECT config, count(*) AS seeds, count_if(ok) AS certified, round(median(loss), 6) AS median_loss, round(min(loss), 6) AS min_loss, round(max(loss), 6) AS max_loss, array_to_string(list_sort(list_distinct(flatten(list(bl)))), ',') AS blocked, round(max(loss) - min(loss), 6) AS spread FROM s GROUP BY config) SELECT *, certified = seeds AS passed FROM a""")
def g15_sweep_verdict(spark, sf_dir):
    """Users stand for seeds of a configuration, which an event type names; a mean value up to 50 passes."""
    e = views.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("config"), F.col("user_id").alias("seed")).agg(F.avg("value").alias("final_loss")).withColumn("passed", F.col("final_loss") <= 50)
    names = F.when(F.col("passed"), F.array().cast("array<string>")).when(F.col("seed") % 2 == 0, F.array(F.lit("ece"))).otherwise(F.array(F.lit("ece"), F.lit("sample_size")))
    return rounded(gates.sweep_verdict(e.withColumn("blocked", names), ["config"]), "median_loss", "min_loss", "max_loss", "spread")


# ---- splits -----------------------------------------------------------------------------------


@register(f"""WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY {draw_sql('carve', 'o_orderkey')}, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F'), e AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'), n AS (SELECT (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM e) AS m),
    k AS (SELECT least(1000, floor(n / 4)) AS c, n, m FROM n), u AS (SELECT c, least(greatest(0, 6000 - m), floor((n - c) / 2)) AS u FROM k)
    SELECT o_orderkey, CASE WHEN r <= c THEN 'calibration' WHEN r <= c + u THEN 'eval' ELSE 'train' END AS split FROM t, u UNION ALL SELECT o_orderkey, 'eval' FROM e""")
def p3_carve_splits(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return splits.carve_splits(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'P'").drop("o_orderstatus"), "o_orderkey", 1000, 6000)


@register(f"""WITH c AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {draw_sql('mix', 'event_id')}, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY ALL ORDER BY 1 LIMIT 2) AND user_id % 7 <> 3),
    q AS (SELECT event_id, r, n, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 300 ELSE 500 END AS t, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 100 ELSE 0 END AS k FROM c)
    SELECT event_id, CASE WHEN r <= least(k, floor(n / 4)) THEN 'calibration' ELSE 'train' END AS split FROM q WHERE r <= least(k, floor(n / 4)) + t""")
def p4_mix(spark, sf_dir):
    """Event types are corpora of which two are mixed, the first alone with calibration rows; a residue of users is a domain held out."""
    e = views.table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 7).cast("string").alias("domain"))
    first, second = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    return splits.mix(e, "event_type", "event_id", {first: (300, 100), second: (500, 0)}, "domain", ["3"]).select("event_id", "split")


@register("SELECT DISTINCT trim(text) AS text FROM conversations WHERE text IS NOT NULL")
def p6_dump_texts(spark, sf_dir):
    return splits.dump_texts(views.table(spark, sf_dir, "conversations"), "text")


@register("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 40")
def p10_limit_cases(spark, sf_dir):
    return splits.limit_cases(views.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderpriority"), "o_orderkey", 40)


@register("""WITH RECURSIVE s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS len, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem)),
    w AS (SELECT l_orderkey, l_linenumber, k, 0 AS part, 1 AS size, len AS wide FROM s WHERE k = 1 UNION ALL
      SELECT s.l_orderkey, s.l_linenumber, s.k, CASE WHEN (w.size + 1) * pow(greatest(w.wide, s.len), 2) > 2000 THEN w.part + 1 ELSE w.part END, CASE WHEN (w.size + 1) * pow(greatest(w.wide, s.len), 2) > 2000 THEN 1 ELSE w.size + 1 END, CASE WHEN (w.size + 1) * pow(greatest(w.wide, s.len), 2) > 2000 THEN s.len ELSE greatest(w.wide, s.len) END
      FROM w JOIN s ON s.l_orderkey = w.l_orderkey AND s.k = w.k + 1) SELECT l_orderkey, l_linenumber, part FROM w""")
def p12_pack_budget(spark, sf_dir):
    """Orders are batches, quantities lengths."""
    li = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("len")).distinct()
    return splits.pack_budget(li, "l_orderkey", "l_linenumber", "len", 2000)


# ---- lexical decisions ---------------------------------------------------------------------------

LEXICAL = f"""WITH o AS (SELECT item_id AS idx, text FROM benchmark), {tokens_sql('t', 'o', 'idx')}, {tokens_sql('q', 'documents', 'doc_id')}, c AS (SELECT doc_id, token, count(*) AS n FROM q GROUP BY ALL), d AS (SELECT DISTINCT idx, token FROM t), z AS (SELECT idx, count(*) AS z FROM d GROUP BY idx),
    s AS (SELECT doc_id, idx, round(sum(ln(1 + n) * ln(1 + length(token))) / sqrt(max(z)) / 2, 6) AS logit FROM c JOIN d USING (token) JOIN z USING (idx) GROUP BY ALL)"""


@register(f"{LEXICAL} SELECT doc_id AS case_id, o.idx, coalesce(logit, 0) AS logit FROM documents CROSS JOIN o LEFT JOIN s USING (doc_id, idx)")
def x4_lexical_decide(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "text")
    got = retrieval.lexical_decide(docs, views.items(spark, sf_dir))
    return got.select("case_id", F.posexplode("logits").alias("idx", "logit")).select("case_id", F.col("idx").cast("long").alias("idx"), F.round("logit", 6).alias("logit"))


@register("SELECT event_type, round(('0x' || substr(sha256('7:' || sha256(event_type)), 1, 2))::UBIGINT / 255.0 * 0.5, 6) AS prior FROM (SELECT DISTINCT event_type FROM events)")
def x4_pseudo_prior(spark, sf_dir):
    """A fingerprint of each event type stands for a question's."""
    e = views.table(spark, sf_dir, "events").select("event_type").distinct()
    return e.select("event_type", F.round(retrieval.pseudo_prior(F.sha2("event_type", 256), 7), 6).alias("prior"))


@register("SELECT o_orderkey, count(*) > 4 OR CAST(sum(l_quantity) AS BIGINT) > 120 AS narrow FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def x11_needs_retrieval(spark, sf_dir):
    """Lines stand for options, quantities for tokens; limits are set so that both sides occur."""
    q = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("options"), F.sum("l_quantity").cast("long").alias("tokens"))
    return retrieval.needs_retrieval(q.join(views.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_semi"), most_options=4, most_tokens=120).select("o_orderkey", "narrow")


def _slots() -> str:
    cells = ", ".join(f"{{'u': {u_sql(chr(39) + 'drop|' + chr(39) + f' || idx || {chr(39)}|{chr(39)} || dr || {chr(39)}|{i}{chr(39)}')}, 'i': {i}, 't': {c}}}" for i, c in enumerate(("a", "b", "c")))
    return f"[{cells}]"


@register(f"""WITH p AS (SELECT p_partkey - 1 AS idx, p_name AS a, p_brand AS b, p_type AS c FROM part), o AS (SELECT idx, a || ' ' || b || ' ' || c AS text FROM p), dd AS (SELECT unnest([0, 1, 2]) AS dr),
    k AS (SELECT dr, idx, list_sort({_slots()}) AS s FROM p, dd), qq AS (SELECT dr || '|' || idx AS qid, array_to_string(list_transform(list_sort(list_transform(s[dr + 1:], lambda x: {{'i': x.i, 't': x.t}})), lambda x: x.t), ' ') AS text FROM k),
    {tokens_sql('t', 'o', 'idx')}, {tokens_sql('q', 'qq', 'qid')}, tf AS (SELECT idx, token, count(*) AS tf FROM t GROUP BY ALL), sz AS (SELECT idx, count(*) AS sz FROM t GROUP BY idx), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
    st AS (SELECT (SELECT count(*) FROM o) AS n, (SELECT count(*) FROM t) / (SELECT count(*) FROM o) AS av),
    s AS (SELECT qid, idx, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sz / av))), 9) AS score FROM (SELECT DISTINCT qid, token FROM q) JOIN tf USING (token) JOIN sz USING (idx) JOIN df USING (token), st GROUP BY ALL),
    r AS (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS rank FROM s), h AS (SELECT dr, rank FROM k LEFT JOIN r ON r.qid = dr || '|' || k.idx AND r.idx = k.idx),
    z AS (SELECT dr, kk AS k, count(*) AS n, avg(CASE WHEN rank <= kk THEN 1.0 ELSE 0.0 END) AS rc FROM h, (SELECT unnest([1, 10, 50]) AS kk) GROUP BY ALL) SELECT CAST(dr AS INTEGER) AS "drop", CAST(k AS INTEGER) AS k, n, round(rc, 6) AS recall, rc >= 0.99 AS passed FROM z""")
def x9_recall_sweep(spark, sf_dir):
    """Parts are options of three slots; every part is asked for with none, one or two of its slots left out."""
    p = views.table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("idx"), "p_name", "p_brand", "p_type")
    options = p.select("idx", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return rounded(retrieval.recall_sweep(options, retrieval.drop_slots(p, ["p_name", "p_brand", "p_type"], [0, 1, 2]), [1, 10, 50]), "recall")


# ---- loaders and wire -------------------------------------------------------------------------------


@register("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('R', 'A') OR l_linestatus = 'O' THEN 1 ELSE 0 END AS y FROM lineitem")
def c8_any_mark(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").withColumns({"back": F.col("l_returnflag").isin("R", "A").cast("string"), "open": F.when(F.col("l_linestatus") == "O", "1").otherwise("0.0")})
    return li.select("l_orderkey", "l_linenumber", loaders.any_mark({"y": ["back", "open"]})["y"].alias("y"))


@register("""WITH c AS (SELECT DISTINCT c_mktsegment AS name FROM customer), t AS (SELECT name, CASE length(name) % 3 WHEN 0 THEN 'green' WHEN 1 THEN 'amber' ELSE 'red' END AS tier, CASE WHEN name LIKE 'B%' THEN 'CC BY-SA 4.0' ELSE 'CC BY 4.0' END AS l FROM c)
    SELECT name, tier = 'green' AND l <> 'CC BY-SA 4.0' AS train, tier IN ('green', 'amber') AS eval FROM t""")
def c1_permits(spark, sf_dir):
    """Market segments stand for corpora."""
    c = views.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    tier = F.element_at(F.array(F.lit("green"), F.lit("amber"), F.lit("red")), F.length("name") % 3 + 1)
    corpora = c.select("name", tier.alias("tier"), F.when(F.col("name").startswith("B"), "CC BY-SA 4.0").otherwise("CC BY 4.0").alias("licence"))
    train = loaders.permits(corpora, "train").select("name", F.col("permitted").alias("train"))
    return train.join(loaders.permits(corpora, "eval").select("name", F.col("permitted").alias("eval")), "name")


@register("""WITH l AS (SELECT list_sort(list(DISTINCT o_orderpriority)) AS ls FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW') SELECT o_orderkey, CAST(list_position(ls, o_orderpriority) - 1 AS INTEGER) AS y FROM orders, l WHERE list_contains(ls, o_orderpriority)""")
def c11_intent_cases(spark, sf_dir):
    """The lowest priority stands for texts out of scope, filled orders for the training split."""
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return loaders.intent_cases(o, (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "5-LOW"), "o_orderkey", "o_orderpriority").select(F.col("state_text").alias("o_orderkey"), "y")


@register(f"""WITH {scored_sql()} SELECT case_id, 'score' AS kind, ty[CAST(list_position(probs, list_max(probs)) AS BIGINT)] AS selected, round(list_max(probs), 6) AS top FROM sc, sc_t""")
def c29_restore_levels(spark, sf_dir):
    """Every answer goes out with levels named by index and comes back with their names."""
    s = views.event_scored(spark, sf_dir)
    wire = F.to_json(F.struct(F.lit("score").alias("type"), F.map_from_arrays(F.transform("labels", lambda x, i: i.cast("string")), "probs").alias("probabilities")))
    back = loaders.answer_to_native(s.select("case_id", "labels", wire.alias("body")), "body", "labels")
    return back.select("case_id", "kind", "selected", F.round(F.try_element_at("probabilities", F.col("selected")), 6).alias("top"))


@register(f"""WITH {scored_sql()}, r AS (SELECT case_id, ty, probs, ty[CAST(list_position(probs, list_max(probs)) AS BIGINT)] AS s FROM sc, sc_t) SELECT case_id, s AS choice, ty[i + 1] AS label, round(probs[i + 1], 6) AS p FROM r, (SELECT unnest(range(5)) AS i)""")
def c29_from_native(spark, sf_dir):
    """Every answer as the other contract's JSON, read again."""
    s = views.event_scored(spark, sf_dir).withColumns({"selected": F.element_at("labels", V.argmax("probs") + 1), "score": F.lit(None).cast("double"), "confidence": F.array_max("probs"), "criteria": F.col("labels")})
    body = F.from_json(loaders.from_native(s), loaders.WIRE_ANSWER)
    return s.select("case_id", body.alias("b")).select("case_id", F.col("b.choice").alias("choice"), F.explode("b.probabilities").alias("label", "p")).withColumn("p", F.round("p", 6))


@register("""WITH c AS (SELECT l_orderkey AS step, l_linenumber AS node, CAST(l_linenumber - 1 AS INTEGER) AS place, l_linenumber = 1 AS t, CASE WHEN l_orderkey % 2 = 0 THEN 'CLICK' ELSE 'SELECT' END AS op, l_returnflag = 'A' AS sel FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_returnflag)),
    h AS (SELECT step, op, place, t, unnest(list_filter(['CLICK', CASE WHEN sel OR (t AND op = 'SELECT') THEN 'SELECT' END], lambda x: x IS NOT NULL)) AS head FROM c), g AS (SELECT step, op, head, count(*) AS n, list(place + 1 ORDER BY place) AS names, list(t ORDER BY place) AS ts FROM h GROUP BY ALL),
    k AS (SELECT step FROM g GROUP BY step HAVING count(*) >= 2 AND max(n) FILTER (head = op) >= 2) SELECT step, head, array_to_string(names, ',') AS names, CASE WHEN head = op THEN CAST(list_position(ts, true) - 1 AS INTEGER) END AS y FROM g WHERE step IN (FROM k) AND n >= 2""")
def c20_step_targets(spark, sf_dir):
    """Lines of an order are its candidates, the first one its target."""
    li = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("step"), F.col("l_linenumber").alias("node")).agg(F.min("l_returnflag").alias("flag"))
    c = li.withColumns({"place": F.col("node") - 1, "is_target": F.col("node") == 1, "operation": F.when(F.col("step") % 2 == 0, "CLICK").otherwise("SELECT")})
    got = loaders.step_targets(c, "step", {"CLICK": F.lit(True), "SELECT": F.col("flag") == "A"})
    return got.select("step", "head", F.array_join("names", ",").alias("names"), "y")


@register(f"""WITH {scored_sql()} SELECT case_id, CASE WHEN user_id % 3 = 0 THEN CASE WHEN probs[2] / (probs[1] + probs[2]) >= 0.5 THEN 'yes' ELSE 'no' END ELSE ty[CAST(list_position(probs, list_max(probs)) AS BIGINT)] END AS decision FROM sc, sc_t""")
def d23_decision(spark, sf_dir):
    """A third of the users' answers are yes/no between the first two labels, a third a score's levels, the others a choice."""
    s = views.event_scored(spark, sf_dir)
    third = F.col("user_id") % 3
    noul = V.normalize(F.slice("probs", 1, 2))
    kind, probs = F.when(third == 0, "noul").when(third == 1, "score").otherwise("choice"), F.when(third == 0, noul).otherwise(F.col("probs"))
    return s.select("case_id", serving.decision(kind, F.col("labels"), probs).alias("decision"))


@register(f"""WITH {scored_sql()} SELECT case_id, i AS idx, CASE WHEN user_id % 5 = i THEN NULL ELSE round(probs[i + 1], 6) END AS p FROM sc, (SELECT unnest(range(5)) AS i)""")
def d10_align(spark, sf_dir):
    """Answers as maps without one of their labels, put back in declared order."""
    s = views.event_scored(spark, sf_dir)
    entries = F.filter(F.map_entries(F.map_from_arrays(F.reverse("labels"), F.reverse("probs"))), lambda e: e["key"] != F.element_at("labels", (F.col("user_id") % 5 + 1).cast("int")))
    got = serving.align(s.select("case_id", F.map_from_entries(entries).alias("answer")), s.select("case_id", "labels"), ["case_id"])
    return got.select("case_id", F.posexplode("probs").alias("idx", "p")).select("case_id", F.col("idx").cast("long").alias("idx"), F.round("p", 6).alias("p"))


@register(f"""WITH {scored_sql()}, r AS (SELECT case_id, probs, list_sort(list_transform(list_grade_up(probs, 'DESC')[1:2], lambda i: i - 1)) AS s FROM sc) SELECT case_id, i AS idx, round(CASE WHEN list_contains(s, i) THEN probs[i + 1] ELSE 0 END, 6) AS p FROM r, (SELECT unnest(range(5)) AS i)""")
def x10_expand_shortlist(spark, sf_dir):
    """The two likeliest labels are the shortlist."""
    s = views.event_scored(spark, sf_dir).withColumn("idx", V.top_k("probs", 2)).withColumns({"n": F.size("labels"), "kept": V.let(F.col("probs"), lambda p: F.transform("idx", lambda i: F.element_at(p, i + 1)))})
    got = retrieval.expand_shortlist(s, "n", "idx", "kept")
    return got.select("case_id", F.posexplode("kept").alias("idx", "p")).select("case_id", F.col("idx").cast("long").alias("idx"), F.round("p", 6).alias("p"))


@register(f"""WITH {scored_sql()}, d AS (SELECT case_id, list_transform(probs, lambda p: round(p, 1)) AS ds FROM sc) SELECT case_id, CAST(list_position(ds, list_max(ds)) - 1 AS INTEGER) AS y FROM d""")
def c26_majority_labels(spark, sf_dir):
    s = views.event_scored(spark, sf_dir).select("case_id", F.transform("probs", lambda p: F.round(p, 1)).alias("distribution"))
    return C.majority_labels(s).where("distribution is null").select("case_id", "y")


@register(f"""WITH {scored_sql()} SELECT domain, count(*) AS n, round(avg(list_max(probs)), 6) AS confidence, round(avg(CASE WHEN list_max(probs) > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS confident FROM sc GROUP BY domain""")
def r12_ambiguity(spark, sf_dir):
    s = views.event_scored(spark, sf_dir).select("domain", F.array_max("probs").alias("confidence"))
    return rounded(variants.ambiguity(s, ["domain"]), "confidence", "confident")


@register(f"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS word, unnest(range(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')))) AS w FROM conversations), u AS (SELECT conv_id, turn, w, word, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS text, conv_id || '-' || turn || '-' || w AS k FROM w),
    a AS (SELECT * FROM u WHERE len(text) >= 2), {tokens_sql('t', "(SELECT k, text FROM a)", 'k')}, q AS (SELECT conv_id, string_agg(text, ' ') AS text FROM conversations WHERE turn = (SELECT min(turn) FROM conversations) GROUP BY conv_id), {tokens_sql('z', 'q', 'conv_id')}
    SELECT DISTINCT u.conv_id, u.turn, u.w, u.word FROM u JOIN t USING (k) JOIN z ON z.conv_id = u.conv_id AND z.token = t.token""")
def e2_lexical_evidence(spark, sf_dir):
    """Words of a conversation whose stem occurs in its first turn."""
    c = views.table(spark, sf_dir, "conversations")
    low = c.agg(F.min("turn").alias("_t"))
    first = c.crossJoin(F.broadcast(low)).where("turn = _t").select("conv_id", "text")
    words = E.word_spans(c, "text", ["conv_id", "turn"])
    asked = words.select("conv_id", "turn").distinct().join(first, "conv_id")
    return H.lexical_evidence(words, asked, ["conv_id", "turn"]).select("conv_id", "turn", "w", "word")


@register(f"""WITH {scored_sql()} SELECT domain, count(*) AS n, round(avg(l), 6) AS mean FROM (SELECT domain, list_sum(list_transform(probs, lambda p: ln(p))) AS l FROM sc) GROUP BY domain""")
def f14_logit_rows(spark, sf_dir):
    s = B.logit_rows(views.event_scored(spark, sf_dir).drop("logits"))
    return rounded(s.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.avg(V.total("logits")).alias("mean")), "mean")


@register(f"""WITH {scored_sql()} SELECT case_id, CAST(CASE user_id % 3 WHEN 0 THEN y WHEN 1 THEN list_position(probs, list_max(probs)) - 1 ELSE CASE WHEN list_max(probs) >= 0.5 THEN 1 ELSE 0 END END AS INTEGER) AS y FROM sc""")
def m8_hard_label(spark, sf_dir):
    """A third of the users have labels, a third distributions, the others a probability of yes."""
    s = views.event_scored(spark, sf_dir)
    kind = F.col("user_id") % 3
    given = serving.hard_label(F.when(kind == 0, F.col("y")), F.when(kind == 1, F.col("probs")), F.when(kind == 2, F.array_max("probs")))
    return s.select("case_id", given.alias("y"))


@register("SELECT event_id, CASE WHEN regexp_matches(event_type, '^[a-z][a-z0-9_]*$') THEN event_type ELSE 'q1' END || ',q2' AS ids FROM events")
def l6_repair_ids(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.select("event_id", F.array_join(teacher.repair_ids(F.array(F.col("event_type"), F.lit("Not snake"))), ",").alias("ids"))


@register("""WITH s AS (SELECT user_id AS shard, count_if(value > 20) AS kept, count_if(value <= 20 AND value > 10) AS a, count_if(value <= 10) AS b, sum(value) AS seconds FROM events GROUP BY user_id) SELECT CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(kept + a + b) AS BIGINT) AS planned, round(sum(seconds), 3) AS seconds, round(1000 * sum(seconds) * 0.001 / sum(kept), 6) AS usd_per_1k FROM s""")
def l7_build_cost(spark, sf_dir):
    """Users stand for shards of a build; low values for rejected cases."""
    e = views.table(spark, sf_dir, "events")
    shards = e.groupBy("user_id").agg(F.count_if(F.col("value") > 20).alias("kept"), F.count(F.lit(1)).alias("planned"), F.sum("value").alias("seconds"))
    out = teacher.build_cost(shards, 0.001)
    return out.select("kept", "planned", F.round("seconds", 3).alias("seconds"), F.round("usd_per_1k", 6).alias("usd_per_1k"))


@register(f"""WITH {HALVES}, fr AS (SELECT * FROM h WHERE NOT held), {_fit_sql('fr')}, g AS (SELECT domain, count(*) AS n, sum(correct) AS r FROM h WHERE held GROUP BY domain),
    b AS (SELECT domain, bin, count(*) AS n, sum(correct) AS c, sum(conf) AS f FROM h WHERE held GROUP BY ALL), e0 AS (SELECT domain, sum(abs(c - f)) / sum(n) AS ece_before FROM b GROUP BY domain),
    wx AS (SELECT domain, y, list_transform(logits, lambda v: exp((v - list_max(logits)) / t)) AS e FROM h JOIN fit USING (domain) WHERE held), wp AS (SELECT domain, y, list_position(e, list_max(e)) - 1 AS a, round(list_max(e) / list_sum(e), 9) AS conf FROM wx),
    wb AS (SELECT domain, least(floor(conf / (1.0::DOUBLE / 15)), 14) AS bin, count(*) AS n, sum(conf) AS f, sum(CASE WHEN a = y THEN 1.0 ELSE 0.0 END) AS c FROM wp GROUP BY ALL), e1 AS (SELECT domain, sum(abs(c - f)) / sum(n) AS ece_after FROM wb GROUP BY domain)
    SELECT domain, g.n, round(r / g.n, 6) AS accuracy, round(ece_before, 6) AS ece_before, round(ece_after, 6) AS ece_after, round(t, 6) AS t FROM g JOIN e0 USING (domain) JOIN e1 USING (domain) JOIN fit USING (domain)""")
def f15_regate(spark, sf_dir):
    """Every domain is a run: refitted on one part, judged on the other."""
    s = splits.hash_holdout(views.event_scored(spark, sf_dir), "case_id", 0.3)
    out = O.regate(s.where("not held_out"), s.where("held_out"), ["domain"])
    return rounded(out, "accuracy", "ece_before", "ece_after", "t")
