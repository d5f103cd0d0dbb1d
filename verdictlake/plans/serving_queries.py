"""Registered queries over decisions as a table job and over calibrator choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import bootstrap as B
from ..operators import calibration as K
from ..operators import compare as J
from ..operators import fits
from ..operators import serving as S
from . import views
from .registry import draw_sql, register, rounded, scored_sql

CUTS = " + ".join(f"CASE WHEN u >= {p!r} THEN 1 ELSE 0 END" for p in B.POISSON)


def _arms(spark, sf_dir):
    rows = views.event_scored(spark, sf_dir).withColumn("warm", V.softmax("logits", 1.5))
    return B.arms(rows, ["case_id", "domain"], "probs", "warm")


def _mass(name: str, source: str, conf: str, out: str) -> str:
    return f"""{name}_n AS (SELECT domain, round({conf}, 3) AS cell, count(*) AS n FROM {source} GROUP BY ALL),
    {name}_c AS (SELECT domain, cell, CAST(floor((sum(n) OVER (PARTITION BY domain ORDER BY cell) - n) * 15 / sum(n) OVER (PARTITION BY domain)) AS INTEGER) AS {out} FROM {name}_n),
    {name} AS (SELECT {source}.*, {out} FROM {source} JOIN {name}_c ON {source}.domain = {name}_c.domain AND round({source}.{conf}, 3) = cell)"""


REPLICATES = f"""WITH {scored_sql()}, x AS (SELECT case_id, domain, y, conf AS conf_a, correct AS ok_a, list_transform(logits, lambda v: exp((v - list_max(logits)) / 1.5)) AS ex FROM sc),
    p AS (SELECT case_id, domain, y, conf_a, ok_a, round(list_max(ex) / list_sum(ex), 9) AS conf_b, CASE WHEN list_position(ex, list_max(ex)) - 1 = y THEN 1.0 ELSE 0.0 END AS ok_b FROM x),
    {_mass('qa', 'p', 'conf_a', 'ma')}, {_mass('qb', 'qa', 'conf_b', 'mb')},
    h AS (SELECT *, sha256('boot|' || CAST(block AS VARCHAR) || '|' || CAST(case_id AS VARCHAR)) AS digest FROM qb, (SELECT unnest(range(13)) AS block)),
    d AS (SELECT *, block * 16 + place AS rep, ('0x' || substr(digest, place * 4 + 1, 4))::UBIGINT / 65536.0 AS u FROM h, (SELECT unnest(range(16)) AS place) WHERE block * 16 + place < 200),
    w AS (SELECT *, {CUTS} AS w FROM d),
    k AS (SELECT domain, rep, y, w, unnest([{{'arm': 'a', 'kind': 'w', 'bin': least(floor(conf_a / (1.0::DOUBLE / 15)), 14), 'gap': ok_a - conf_a}}, {{'arm': 'a', 'kind': 'm', 'bin': ma, 'gap': ok_a - conf_a}}, {{'arm': 'b', 'kind': 'w', 'bin': least(floor(conf_b / (1.0::DOUBLE / 15)), 14), 'gap': ok_b - conf_b}}, {{'arm': 'b', 'kind': 'm', 'bin': mb, 'gap': ok_b - conf_b}}]) AS k FROM w WHERE w > 0),
    b AS (SELECT domain, rep, k.arm AS arm, k.kind AS kind, k.bin AS bin, sum(w) AS w, sum(w * k.gap) AS gap, min(y) AS lo, max(y) AS hi FROM k GROUP BY ALL),
    e AS (SELECT domain, rep, arm, kind, sum(abs(gap)) / sum(w) AS e, min(lo) AS lo, max(hi) AS hi FROM b GROUP BY ALL),
    r AS (SELECT domain, rep, max(round(e, 9)) FILTER (arm = 'a') AS err_a, max(round(e, 9)) FILTER (arm = 'b') AS err_b FROM e GROUP BY ALL HAVING min(lo) < max(hi))"""


@register(f"{REPLICATES} SELECT domain, count(*) AS counted, count_if(err_b < err_a) AS better, count_if(err_b < err_a) >= 0.8 * count(*) AS accepted FROM r GROUP BY domain")
def f8_help_is_real(spark, sf_dir):
    return B.help_is_real(_arms(spark, sf_dir), ["domain"])


@register(f"{REPLICATES} SELECT domain, count(*) AS counted, count_if(err_b > err_a) AS worse, count_if(err_b > err_a) >= 0.95 * count(*) AS harmful FROM r GROUP BY domain")
def f9_harm_is_real(spark, sf_dir):
    return B.harm_is_real(_arms(spark, sf_dir), ["domain"])


@register()
def f11_fit_calibration(spark, sf_dir):
    """One choice for each domain's answers, taken as kinds."""
    rows = views.event_scored(spark, sf_dir).withColumns({"kind": F.concat(F.lit("d"), "domain"), "from_teacher": F.lit(False)})
    return B.fit_calibration(rows)


@register(f"""WITH {scored_sql()}, x AS (SELECT unnest([domain, NULL]) AS source, bin, conf, correct FROM sc), b AS (SELECT source, bin, count(*) AS n, sum(correct) AS c, sum(conf) AS f FROM x GROUP BY ALL)
    SELECT 'choice' AS kind, source, CAST(sum(n) AS BIGINT) AS n, round(sum(c) / sum(n), 6) AS accuracy, round(sum(f) / sum(n), 6) AS confidence, round(sum(abs(c - f)) / sum(n), 6) AS ece FROM b GROUP BY source""")
def f12_refit_sources(spark, sf_dir):
    s = K.with_confidence(views.event_scored(spark, sf_dir)).select("kind", F.col("domain").alias("source"), "conf", "correct")
    return rounded(B.refit_sources(s, "kind", "source"), "accuracy", "confidence", "ece")


@register(f"""WITH {scored_sql()}, t AS (SELECT *, CASE WHEN domain IN ('0', '1') THEN 0.5 + CAST(domain AS INTEGER) ELSE 2.0 END AS t FROM sc), e AS (SELECT *, list_transform(logits, lambda v: exp((v - list_max(logits)) / t)) AS e FROM t), w AS (SELECT case_id, list_transform(e, lambda v: v / list_sum(e)) AS w FROM e),
    g AS (SELECT *, list_max(w) AS top, CASE WHEN round(list_max(w), 9) <= 0.4 THEN 0.35 WHEN round(list_max(w), 9) <= 0.6 THEN 0.55 ELSE 0.8 END AS g FROM w),
    p AS (SELECT case_id, list_transform(range(5), lambda i: CASE WHEN i = list_position(w, top) - 1 THEN g ELSE w[i + 1] * ((1 - g) / greatest(1 - top, 1e-12)) END) AS p FROM g)
    SELECT case_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS selected, round(greatest(0, least(1, 1 + list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) / ln(5))), 6) AS confidence,
      round(list_max(p), 6) AS top FROM p""")
def d8_decide(spark, sf_dir):
    """Two domains have their own temperature, the others take the kind's; the kind has three steps."""
    s = views.event_scored(spark, sf_dir)
    kinds = s.select("kind", "domain").distinct()
    by_domain = kinds.where("domain in ('0', '1')").select("domain", "kind", (F.col("domain").cast("double") + 0.5).alias("t"))
    one = kinds.select("kind").distinct()
    step = [F.struct(F.lit(low).cast("double").alias("low"), F.lit(right).alias("right"), F.lit(value).alias("value")) for low, right, value in ((None, 0.4, 0.35), (0.4, 0.6, 0.55), (0.6, 1.0, 0.8))]
    knots = one.select("kind", F.explode(F.array(*step)).alias("k")).select("kind", "k.*")
    return rounded(S.decide(s, by_domain, one.withColumn("t", F.lit(2.0)), knots).select("case_id", "selected", "confidence", F.array_max("probs").alias("top")), "confidence", "top")


def _questions(spark, sf_dir):
    """Order lines as questions of their order."""
    li = views.table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(F.lit("choice"), F.lit("score"), F.lit("noul")), F.col("l_linenumber") % 3 + 1)
    names = F.array("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))
    return li.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("qid"), kind.alias("kind"), F.concat_ws(" ", "l_returnflag", "l_suppkey", "l_partkey").alias("instructions"), names.alias("names"), "l_partkey", "l_suppkey")


QUESTIONS = "q AS (SELECT l_orderkey AS case_id, l_linenumber AS qid, ['choice', 'score', 'noul'][l_linenumber % 3 + 1] AS kind, l_returnflag || ' ' || l_suppkey || ' ' || l_partkey AS instructions, [l_returnflag, l_linestatus, CAST(l_partkey AS VARCHAR)] AS names, l_partkey, l_suppkey FROM lineitem)"
COMPILED = f"""WITH {QUESTIONS}, t AS (SELECT case_id, CAST(ceil(length(instructions) / 4) + 2 + list_sum(list_transform(names, lambda x: ceil(length(x) / 4) + 2)) AS BIGINT) AS s, CASE WHEN kind = 'noul' THEN 1 ELSE 3 END AS r FROM q),
    c AS (SELECT case_id, count(*) AS questions, CAST(sum(s) AS BIGINT) AS schema, max(s) AS longest, CAST(sum(r) AS BIGINT) AS readout, CAST(sum(s * s + r * (s + r)) AS BIGINT) AS blocks FROM t GROUP BY case_id), m AS (SELECT c.*, CAST(floor(o_totalprice / 10) AS BIGINT) AS state FROM c JOIN orders ON o_orderkey = case_id)"""


def _compiled(spark, sf_dir):
    q = _questions(spark, sf_dir).select("case_id", S.question_tokens(F.col("instructions"), F.col("names")).alias("schema"), F.when(F.col("kind") == "noul", 1).otherwise(3).alias("readout"))
    states = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.floor(F.col("o_totalprice") / 10).alias("state"))
    return S.compiled(q, states, "case_id")


@register(f"""{COMPILED} SELECT case_id, questions, schema, CASE WHEN questions > 64 THEN 'questions' WHEN schema > 40960 THEN 'schema' WHEN state > 16384 THEN 'state' WHEN state + longest > 32768 THEN 'envelope' WHEN readout > 4096 THEN 'readout' WHEN schema + state + readout > 65536 THEN 'context' END AS reason FROM m""")
def d14_admission(spark, sf_dir):
    return S.admit_requests(_compiled(spark, sf_dir)).select("case_id", "questions", "schema", "reason")


@register(f"{COMPILED}, z AS (SELECT case_id, blocks + readout * state + state * state AS pairs, pow(schema + state + readout, 2) AS dense FROM m) SELECT case_id, pairs, CAST(dense AS BIGINT) AS dense, round(1 - pairs / dense, 6) AS saving, CAST(floor(sqrt(pairs)) AS BIGINT) AS equivalent FROM z")
def d16_attention_cost(spark, sf_dir):
    return rounded(S.attention_cost(_compiled(spark, sf_dir)).select("case_id", "pairs", "dense", "saving", "equivalent"), "saving")


@register(f"WITH {QUESTIONS} SELECT case_id, substr(sha256(array_to_string(list_sort(list(sha256(qid || chr(31) || kind || chr(31) || instructions))), '')), 1, 32) AS fingerprint FROM q GROUP BY case_id")
def d15_schema_hashes(spark, sf_dir):
    return S.schema_hashes(_questions(spark, sf_dir), "case_id", "qid", ["kind", "instructions"])


@register("""WITH q AS (SELECT l_partkey, l_orderkey, ['choice', 'score'][l_linenumber % 2 + 1] AS kind, [l_returnflag, l_linestatus] AS names, [l_discount, CASE WHEN l_tax > 0.06 THEN NULL ELSE l_tax END] AS v FROM lineitem),
    r AS (SELECT l_orderkey, CASE WHEN len(list_distinct(names)) < 2 THEN 'repeated' END AS a, CASE WHEN kind = 'score' AND v[2] IS NULL THEN 'partial values' END AS b, CASE WHEN kind = 'score' AND v[1] >= v[2] THEN 'order' END AS c FROM q)
    SELECT concat_ws(',', a, b, c) AS reasons, count(*) AS n FROM r GROUP BY ALL""")
def d12_validate_requests(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(F.lit("choice"), F.lit("score")), F.col("l_linenumber") % 2 + 1)
    q = li.select("l_orderkey", kind.alias("kind"), F.array("l_returnflag", "l_linestatus").alias("names"), F.array(F.col("l_discount"), F.when(F.col("l_tax") <= 0.06, F.col("l_tax"))).alias("values"))
    return S.validate_requests(q, ["l_orderkey"]).groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {scored_sql()}, p AS (SELECT case_id, CASE WHEN case_id % 7 = 0 THEN 'score' ELSE 'choice' END AS kind, CASE WHEN case_id % 5 = 0 THEN 4 ELSE 5 END AS n FROM sc WHERE {draw_sql('gap', 'case_id')} >= 0.1)
    SELECT s.case_id, concat_ws(',', CASE WHEN p.kind IS NULL THEN 'missing' END, CASE WHEN p.kind = 'score' THEN 'kind' END, CASE WHEN p.n = 4 THEN 'count' END) AS reasons FROM sc s LEFT JOIN p USING (case_id)""")
def d11_validate_output(spark, sf_dir):
    """Some answers are missing, of another kind, or short."""
    s = views.event_scored(spark, sf_dir)
    given = s.where(V.uniform("case_id", "gap") >= 0.1).select("case_id", F.when(F.col("case_id") % 7 == 0, "score").otherwise("choice").alias("kind"), F.slice("logits", F.lit(1), F.when(F.col("case_id") % 5 == 0, 4).otherwise(5)).alias("logits"))
    out = S.validate_output(given, s.select("case_id", "kind", F.size("labels").alias("n")), ["case_id"])
    return out.select("case_id", F.array_join("reasons", ",").alias("reasons"))


@register("""WITH v AS (SELECT user_id, try_cast(regexp_replace(props, '[^0-9]', '', 'g') AS INTEGER) AS i FROM events), s AS (SELECT u.user_id, k.k, count(v.i) AS c FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(20)) AS k) k LEFT JOIN v ON v.user_id = u.user_id AND v.i = k.k GROUP BY ALL)
    SELECT user_id, round(max(c + 1.0) / sum(c + 1.0), 6) AS top, CAST(arg_min(k, (-c, k)) AS INTEGER) AS selected FROM s GROUP BY user_id""")
def d19_votes(spark, sf_dir):
    """A user's property texts as votes for one of twenty labels."""
    e = views.table(spark, sf_dir, "events").select("user_id", F.lit(20).alias("n"), F.col("props").alias("reply"))
    return S.votes_to_dist(e, ["user_id"]).select("user_id", F.round(F.array_max("probs"), 6).alias("top"), V.argmax("probs").alias("selected"))


@register("""WITH v AS (SELECT user_id, try_cast(regexp_replace(props, '[^0-9]', '', 'g') AS INTEGER) AS i, exp(-value / 10) AS p FROM events), s AS (SELECT u.user_id, k.k, coalesce(sum(v.p), 0) + 1e-4 AS c FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(20)) AS k) k LEFT JOIN v ON v.user_id = u.user_id AND v.i = k.k GROUP BY ALL)
    SELECT user_id, round(max(c) / sum(c), 6) AS top FROM s GROUP BY user_id""")
def d20_logprobs(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("user_id", F.lit(20).alias("n"), F.col("props").alias("token"), (-F.col("value") / 10).alias("logprob"))
    return S.logprobs_to_dist(e, ["user_id"]).select("user_id", F.round(F.array_max("probs"), 6).alias("top"))


@register("""WITH s AS (SELECT event_id, greatest(CAST(json_extract(props, '$.k') AS DOUBLE), 1e-4) AS k FROM events) SELECT event_id, round(k / (k + 1e-4), 6) AS p FROM s""")
def d21_verbalized(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.select("event_id", F.round(S.verbalized_to_dist(F.col("props"), F.array(F.lit("k"), F.lit("other")))[0], 6).alias("p"))


@register("""WITH t AS (SELECT l_orderkey, l_linenumber, chr(CAST(65 + l_linenumber % 5 AS INTEGER)) AS letter, -l_discount AS lp, (l_linenumber % 5 + l_orderkey) % 4 AS i FROM lineitem),
    f AS (SELECT l_orderkey, i, arg_min(lp, l_linenumber * 1000 - lp) AS l FROM t WHERE letter < 'E' GROUP BY ALL), m AS (SELECT l_orderkey, min(l) AS lo, sum(exp(l)) AS declared FROM f GROUP BY l_orderkey),
    g AS (SELECT m.l_orderkey, k.k, declared, coalesce(f.l, lo - 1) AS v FROM m CROSS JOIN (SELECT unnest(range(4)) AS k) k LEFT JOIN f ON f.l_orderkey = m.l_orderkey AND f.i = k.k)
    SELECT l_orderkey, round(max(declared), 6) AS declared, round(max(exp(v)) / sum(exp(v)), 6) AS top, CAST(arg_min(k, (-v, k)) AS INTEGER) AS selected FROM g GROUP BY l_orderkey""")
def d22_letters(spark, sf_dir):
    """An order's lines as first-token letters over four options, shown from a slot that its key picks."""
    li = views.table(spark, sf_dir, "lineitem")
    order = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: ((s + F.col("l_orderkey")) % 4).cast("int"))
    letter = F.char(F.lit(65) + F.col("l_linenumber") % 5)
    t = li.select("l_orderkey", order.alias("order"), (F.col("l_linenumber") * 1000 + F.col("l_discount")).alias("pos"), F.concat(F.lit(" "), letter).alias("token"), (-F.col("l_discount")).alias("logprob"))
    out = S.letters_to_dist(t, ["l_orderkey"])
    return out.select("l_orderkey", F.round("declared", 6).alias("declared"), F.round(F.array_max("probs"), 6).alias("top"), V.argmax("probs").alias("selected"))


@register(f"""WITH {scored_sql('a')}, {scored_sql('b', 'v', 0.6)}, j AS (SELECT a.case_id, a.probs AS p, b.probs AS q, a.y FROM a JOIN b USING (case_id)),
    c AS (SELECT *, list_transform(range(5), lambda i: list_sum(p[1:i + 1]) - list_sum(q[1:i + 1])) AS d FROM j)
    SELECT case_id, round(list_sum(list_transform(range(5), lambda i: p[i + 1] * ln(p[i + 1] / q[i + 1]))), 6) AS kl, round(list_sum(list_transform(range(5), lambda i: abs(p[i + 1] - q[i + 1]))) / 2, 6) AS tv, round(list_sum(list_transform(d, lambda x: x * x)), 6) AS emd,
      round(list_sum(list_transform(range(5), lambda i: p[i + 1] * ln(p[i + 1] / q[i + 1]) + q[i + 1] * ln(q[i + 1] / p[i + 1]))) / 2, 6) AS same, round(-list_sum(list_transform(range(5), lambda i: p[i + 1] * ln(q[i + 1]))), 6) AS soft_ce FROM c""")
def m3_divergences(spark, sf_dir):
    """Divergences between two answers to the same question."""
    p = views.event_scored(spark, sf_dir).select("case_id", "probs")
    q = views.event_scored(spark, sf_dir, "v", 0.6).select("case_id", F.col("probs").alias("other"), "logits")
    return p.join(q, "case_id").select(
        "case_id", F.round(V.kl("probs", "other"), 6).alias("kl"), F.round(V.total_variation("probs", "other"), 6).alias("tv"), F.round(V.squared_emd("probs", "other"), 6).alias("emd"),
        F.round(V.consistency("probs", "other", "same"), 6).alias("same"), F.round(V.soft_cross_entropy("logits", "probs"), 6).alias("soft_ce"),
    )


@register(f"""WITH {scored_sql()}, c AS (SELECT case_id, probs, {draw_sql('label', 'case_id')} AS u FROM sc) SELECT case_id, CAST(least(len(list_filter(list_transform(range(1, 6), lambda i: list_sum(probs[1:i])), lambda x: x <= u)), 4) AS INTEGER) AS drawn FROM c""")
def m9_draw_label(spark, sf_dir):
    return views.event_scored(spark, sf_dir).select("case_id", V.draw_label("case_id", "probs").alias("drawn"))


@register(f"""WITH {scored_sql()}, e AS (SELECT case_id, list_transform(probs, lambda p: pow(greatest(p, 1e-12), 2.0 / 0.5)) AS w FROM sc) SELECT case_id, round(list_max(w) / list_sum(w), 6) AS top FROM e""")
def m11_recalibrate(spark, sf_dir):
    s = views.event_scored(spark, sf_dir)
    return s.select("case_id", F.round(F.array_max(S.recalibrate(F.col("probs"), F.lit(2.0), F.lit(0.5))), 6).alias("top"))


@register(f"""WITH {scored_sql('a')}, {scored_sql('b', 'v', 0.6)}, j AS (SELECT a.probs AS p, b.probs AS q FROM a JOIN b USING (case_id)), r AS (SELECT count(*) AS n, avg(CASE WHEN list_position(p, list_max(p)) = list_position(q, list_max(q)) THEN 1.0 ELSE 0.0 END) AS agreement, max(list_max(list_transform(range(5), lambda i: abs(p[i + 1] - q[i + 1])))) AS max_diff FROM j)
    SELECT n, 0::BIGINT AS alone, round(agreement, 6) AS agreement, round(max_diff, 6) AS max_diff, agreement >= 0.98 AND max_diff <= 0.05 AS passed FROM r""")
def j5_parity(spark, sf_dir):
    a, b = views.event_scored(spark, sf_dir), views.event_scored(spark, sf_dir, "v", 0.6)
    return rounded(J.parity(a, b, ["case_id"]), "agreement", "max_diff")
