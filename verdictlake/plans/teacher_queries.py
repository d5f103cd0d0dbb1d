"""Registered queries over teacher streams, annotator ceilings, workflows and corpus layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import calibration as K
from ..operators import cases as C
from ..operators import loaders as L
from ..operators import teacher as T
from . import views
from .registry import draw_sql, register, rounded, scored_sql, u_sql

PAIR = f"WITH {scored_sql('a')}, {scored_sql('b', 'v', 0.6)}, j AS (SELECT a.case_id, a.domain, a.probs AS d, list_position(a.probs, list_max(a.probs)) - 1 AS ty, b.probs AS p, list_position(b.probs, list_max(b.probs)) - 1 AS py FROM a JOIN b USING (case_id))"
KL = "list_sum(list_transform(range(5), lambda i: d[i + 1] * ln(d[i + 1] / {}[i + 1])))"


def _taught(spark, sf_dir):
    return views.event_scored(spark, sf_dir).select("case_id", "domain", F.col("probs").alias("distribution"), V.argmax("probs").alias("y"), F.lit(True).alias("from_teacher"))


@register(f"""{PAIR}, c AS (SELECT domain, ty, count(*) AS n FROM j WHERE case_id % 2 = 0 GROUP BY ALL), m AS (SELECT domain, arg_min(ty, (-n, ty)) AS mode FROM c GROUP BY domain),
    e AS (SELECT domain, i, avg(d[i + 1]) AS p FROM j, (SELECT unnest(range(5)) AS i) WHERE case_id % 2 = 0 GROUP BY ALL), q AS (SELECT domain, list(p ORDER BY i) AS mean FROM e GROUP BY domain)
    SELECT domain, count(*) AS n, round(avg(CASE WHEN py = ty THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(avg(CASE WHEN mode = ty THEN 1.0 ELSE 0.0 END), 6) AS base_agreement, round(avg({KL.format('p')}), 6) AS kl, round(avg({KL.format('mean')}), 6) AS base_kl FROM j JOIN m USING (domain) JOIN q USING (domain) WHERE case_id % 2 = 1 GROUP BY domain""")
def l9_teacher_agreement(spark, sf_dir):
    """One system's answers stand for the teacher's: priors from even cases, agreement on odd ones."""
    taught = _taught(spark, sf_dir)
    priors = T.teacher_priors(taught.where("case_id % 2 = 0"), ["domain"])
    model = views.event_scored(spark, sf_dir, "v", 0.6).select("case_id", "probs")
    out = T.teacher_agreement(taught.where("case_id % 2 = 1").join(model, "case_id"), priors, ["domain"], ["domain"])
    return rounded(out, "agreement", "base_agreement", "kl", "base_kl")


@register(f"""WITH {scored_sql()}, x AS (SELECT domain, unnest([CAST(user_id % 3 AS VARCHAR), NULL]) AS qid, bin, conf, correct FROM sc), b AS (SELECT domain, qid, bin, count(*) AS n, sum(correct) AS c, sum(conf) AS f FROM x GROUP BY ALL)
    SELECT domain, qid, CAST(sum(n) AS BIGINT) AS n, round(sum(c) / sum(n), 6) AS accuracy, round(sum(abs(c - f)) / sum(n), 6) AS ece FROM b GROUP BY ALL""")
def l10_verify_teacher(spark, sf_dir):
    s = K.with_confidence(views.event_scored(spark, sf_dir)).select("domain", (F.col("user_id") % 3).cast("string").alias("qid"), "conf", "correct")
    return rounded(T.verify_teacher(s, "domain", "qid"), "accuracy", "ece")


VOTES = f"""a AS (SELECT l_orderkey AS item, l_linenumber AS rater, CAST(floor(l_quantity) AS BIGINT) % 5 AS v FROM lineitem), g AS (SELECT item, list(v ORDER BY rater, v) AS vs FROM a GROUP BY item HAVING count(*) >= 2),
    i AS (SELECT item, list_transform(range(5), lambda k: len(list_filter(vs, lambda x: x = k))) AS counts, vs[CAST(floor({draw_sql('rater', 'item')} * len(vs)) AS BIGINT) + 1] AS y FROM g)"""


@register(f"""WITH {VOTES}, o AS (SELECT *, list_transform(range(5), lambda k: counts[k + 1] - CASE WHEN k = y THEN 1 ELSE 0 END + CASE WHEN k < 2 THEN 0.6 WHEN k = 2 THEN 0.4 ELSE 0.2 END) AS others FROM i)
    SELECT 'naive' AS oracle, count(*) AS n, round(avg(CASE WHEN list_position(counts, list_max(counts)) - 1 = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM o UNION ALL SELECT 'left out', count(*), round(avg(CASE WHEN list_position(others, list_max(others)) - 1 = y THEN 1.0 ELSE 0.0 END), 6) FROM o""")
def l1_oracles(spark, sf_dir):
    items = C.group_annotators(views.annotators(spark, sf_dir), "item", "rater", F.col("rating"), 5).withColumn("counts", F.transform("distribution", lambda d: F.round(d * F.col("raters")).cast("int")))
    prior = F.array(*[F.lit(p) for p in (0.3, 0.3, 0.2, 0.1, 0.1)])
    a = T.oracle_naive(items.withColumn("oracle", F.lit("naive")), ["oracle"])
    return rounded(a.unionByName(T.oracle_left_out(items.withColumn("oracle", F.lit("left out")), prior, ["oracle"])), "accuracy")


@register("""WITH v AS (SELECT event_id, regexp_matches(props, '\\{"k": [0-9]+\\}') AS ok, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) SELECT CASE WHEN NOT ok THEN 'not JSON' WHEN k % 3 = 0 THEN 'kinds' WHEN k % 5 = 0 THEN 'id' END AS reason, count(*) AS n FROM v GROUP BY 1""")
def l5_parse_generated(spark, sf_dir):
    """A case is written around every event's properties; some have another kind than planned or an id that isn't snake case."""
    e = views.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind, qid = F.when(F.col("k") % 3 == 0, "score").otherwise("noul"), F.when(F.col("k") % 5 == 0, "Not snake").otherwise("q_a")
    text = F.concat(F.lit('Here it is: {"state": "s", "questions": [{"kind": "'), kind, F.lit('", "id": "'), qid, F.lit('"}]} done'))
    got = T.parse_generated(e.select(text.alias("text"), F.array(F.lit("noul")).alias("planned")), "state string, questions array<struct<kind:string,id:string>>", "planned")
    return T.rejections(got.withColumn("reason", F.coalesce("reason", F.lit("kept"))), "reason").select(F.nullif("reason", F.lit("kept")).alias("reason"), "n")


def _answer(shift: int, salt: str):
    return lambda df: df.select("case_id", ((F.col("y") + F.when(V.uniform("case_id", salt) < 0.2, shift).otherwise(0)) % 5).alias("decision"))


@register(f"""WITH ty AS (SELECT list_sort(list(DISTINCT event_type)) AS ty FROM events), e AS (SELECT event_id, user_id % 7 AS domain, list_position(ty, event_type) - 1 AS y FROM events, ty),
    a AS (SELECT *, (y + CASE WHEN {draw_sql('first', 'event_id')} < 0.2 THEN 1 ELSE 0 END) % 5 AS first FROM e), b AS (SELECT *, CASE WHEN first >= 2 THEN (y + CASE WHEN {draw_sql('second', 'event_id')} < 0.2 THEN 2 ELSE 0 END) % 5 END AS second FROM a)
    SELECT CAST(domain AS VARCHAR) AS domain, count(*) AS n, count(*) + count(second) AS judged, round((count_if(first = y) + count_if(second = y)) / (count(*) + count(second)), 6) AS accuracy, round(avg(CASE WHEN second IS NULL THEN 1.0 ELSE 2.0 END), 6) AS mean_calls FROM b GROUP BY domain""")
def l11_workflow(spark, sf_dir):
    """The second step is asked only where the first decided two or more."""
    cases = views.event_scored(spark, sf_dir).select("case_id", "domain", "y")
    done = T.run_workflow(cases, [("first", F.lit(True), _answer(1, "first")), ("second", F.col("first") >= 2, _answer(2, "second"))])
    return rounded(T.workflow_score(done, {"first": "y", "second": "y"}, ["domain"]), "accuracy", "mean_calls")


@register("""WITH u AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS first FROM events)
    SELECT event_type, count(*) AS requests, round(sum(100 + CASE WHEN first THEN 400 ELSE 0 END) * 0.5 / 1e6 + sum(CASE WHEN first THEN 0 ELSE 400 END) * 0.05 / 1e6, 6) AS typed_usd, round(count(*) * 1000 * 3.0 / 1e6 + count(*) * 20 * 15.0 / 1e6, 6) AS prompted_usd FROM u GROUP BY event_type""")
def l13_price(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    firsts = events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("_f"))
    usage = events.join(firsts, "user_id").select("event_type", (F.col("_f.event_id") == F.col("event_id")).alias("first"), *[F.lit(n).alias(c) for c, n in (("schema", 400), ("state", 100), ("prompt", 900), ("output", 20))])
    return rounded(T.price(usage, ["event_type"], 0.5, 0.05, 3.0, 15.0).drop("multiple"), "typed_usd", "prompted_usd")


@register("""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS word, unnest(range(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')))) AS pos FROM conversations),
    p AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY conv_id, turn ORDER BY pos) - length(word) - 1 AS s, length(word) % 4 AS votes FROM t), m AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS g FROM p WHERE votes * 2 > 3)
    SELECT conv_id, turn, CAST(min(s) AS BIGINT) AS start, CAST(max(s + length(word)) AS BIGINT) AS "end" FROM m GROUP BY conv_id, turn, g""")
def c10_token_votes(spark, sf_dir):
    """A word's length mod 4 stands for its votes of three."""
    c = views.table(spark, sf_dir, "conversations")
    words = c.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("pos", "token")).withColumns({"votes": F.length("token") % 4, "raters": F.lit(3)})
    return L.token_votes(words, ["conv_id", "turn"], "votes", "raters")


@register("""WITH c AS (SELECT l_orderkey, l_returnflag AS f, count(*) AS c FROM lineitem GROUP BY ALL), m AS (SELECT l_orderkey, max(c) AS m, sum(c) AS n, arg_max(f, c) AS y FROM c GROUP BY l_orderkey) SELECT l_orderkey, y, CAST(n AS BIGINT) AS n FROM m WHERE m * 2 > n""")
def c10_majority(spark, sf_dir):
    return L.majority_of(views.table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


@register("SELECT p_partkey, upper(p_name[1]) || p_name[2:] || '?' AS question FROM part")
def c12_own_question(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", L.own_question(F.col("p_name")).alias("question"))


@register(f"""WITH t AS (SELECT o_orderkey, o_orderstatus, CAST(floor({draw_sql('nli', 'o_orderkey')} * 3) AS INTEGER) + 1 AS k FROM orders) SELECT o_orderkey, ['Is it open?', 'Is it filled?', 'Is it partial?'][k] AS question, CASE WHEN o_orderstatus = ['O', 'F', 'P'][k] THEN 1 ELSE 0 END AS y FROM t""")
def c13_nli_noul(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return L.nli_noul(orders, "o_orderkey", F.col("o_orderstatus"), [("Is it open?", "O"), ("Is it filled?", "F"), ("Is it partial?", "P")]).drop("o_orderstatus")


@register(f"""SELECT doc_id, ['Is it toxic?', 'Toxic text?'][CAST(floor({draw_sql('phrase', 'doc_id')} * 2) AS INTEGER) + 1] AS question, toxic AS y, length(text) AS n, ['text', 'message'][CAST(floor({draw_sql('field', 'doc_id')} * 2) AS INTEGER) + 1] AS field FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND toxic IS NOT NULL""")
def c14_text_noul(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id").where("text is not null and toxic is not null")
    got = L.text_noul(d, "doc_id", "text", F.col("toxic") == 1, ["Is it toxic?", "Toxic text?"], ["text", "message"])
    state = F.from_json("state_json", "map<string,string>")
    return got.select("doc_id", "question", "y", F.length(F.map_values(state)[0]).alias("n"), F.map_keys(state)[0].alias("field"))


@register("""WITH u AS (SELECT unnest(['prompt', 'response']) AS qid, unnest([quality, toxic]) AS y FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND text <> 'REDACTED') SELECT qid, y, count(*) AS n FROM u WHERE y IS NOT NULL GROUP BY ALL""")
def c15_two_questions(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id")
    return L.two_questions(d, "doc_id", F.col("quality"), F.col("toxic")).groupBy("qid", "y").agg(F.count(F.lit(1)).alias("n"))


@register("""WITH p AS (SELECT p_partkey, [p_name, p_brand, p_type] AS c, CASE WHEN p_size % 2 = 0 THEN chr(CAST(65 + p_size % 5 AS INTEGER)) ELSE CAST(p_size % 5 AS VARCHAR) END AS a, p_size % 5 AS y FROM part) SELECT p_partkey, 'a,b,c' AS options, array_to_string(c, '|') AS criteria, y FROM p WHERE y < 3""")
def c16_multiple_choice(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    answer = F.when(F.col("p_size") % 2 == 0, F.char(F.lit(65) + F.col("p_size") % 5)).otherwise((F.col("p_size") % 5).cast("string"))
    got = L.multiple_choice(p, "p_partkey", F.array("p_name", "p_brand", "p_type"), answer)
    return got.select("p_partkey", F.array_join("options", ",").alias("options"), F.array_join("criteria", "|").alias("criteria"), "y")


@register("""SELECT l_orderkey AS case_id, CAST(l_linenumber AS VARCHAR) AS qid, CAST(l_discount * 100 > 5 AS INTEGER) AS y FROM lineitem UNION ALL SELECT o_orderkey, 'late', CAST(o_orderstatus = 'P' AS INTEGER) FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def c24_known_question(spark, sf_dir):
    cases = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("string").alias("qid"), (F.col("l_discount") * 100 > 5).cast("int").alias("y"))
    flags = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus") == "P").alias("flag"))
    return L.add_known_question(cases, flags, "case_id", "late")


@register("""WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) % 5 AS k FROM events)
    SELECT event_id, 'q' AS qid, ['choice', 'score', 'noul', 'rank', 'choice'][k + 1] AS kind, CASE WHEN k = 2 THEN 'Ask' || chr(10) || 'Counts as true: yes it is' ELSE 'Ask' END AS instructions, CASE k WHEN 0 THEN 'x,y' WHEN 1 THEN '0,1,2' WHEN 2 THEN 'no,yes' END AS options,
      CASE k WHEN 3 THEN 'unknown type' WHEN 4 THEN 'criteria must be an object' END AS reason FROM k""")
def c28_to_native(spark, sf_dir):
    """Questions of five forms, by each event's property; two are refused."""
    e = views.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int") % 5)
    forms = ('"choice","criteria":{"x":"one","y":"two"}', '"score","criteria":["low","mid","high"]', '"noul","criteria":{"true":"yes it is"}', '"rank"', '"choice"')
    body = F.concat(F.lit('{"q":{"instructions":"Ask","type":'), F.element_at(F.array(*[F.lit(f) for f in forms]), F.col("k") + 1), F.lit("}}"))
    got = L.to_native(e.select("event_id", body.alias("body")), "event_id", "body")
    return got.withColumn("options", F.array_join("options", ","))


@register("""SELECT event_id, list_aggregate(list_transform(list_filter(list_sort(list({'t': event_id, 'x': event_type}) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), lambda s: true), lambda s: s.x), 'string_agg', ',') AS history FROM events""")
def c18_step_history(spark, sf_dir):
    got = L.step_history(views.table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")
    return got.select("event_id", F.when(F.size("history") > 0, F.array_join("history", ",")).alias("history"))


@register()
def c19_page_elements(spark, sf_dir):
    return L.page_elements(views.table(spark, sf_dir, "pages"), "page_id")


@register(f"""WITH k AS (SELECT l_orderkey, l_returnflag, l_linenumber, bool_or(l_linenumber = 1) AS t FROM lineitem GROUP BY ALL), u AS (SELECT *, {u_sql("'candidates-keep|' || l_orderkey || '|' || l_linenumber")} AS keep, {u_sql("'candidates-show|' || l_orderkey || '|' || l_linenumber")} AS shown FROM k),
    r AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY t DESC, keep, l_linenumber) <= 2) SELECT l_orderkey AS step, l_returnflag AS operation, l_linenumber AS node, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY shown, l_linenumber) - 1 AS INTEGER) AS place FROM r""")
def c20_step_candidates(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    el = li.groupBy(F.col("l_orderkey").alias("step"), F.col("l_returnflag").alias("operation"), F.col("l_linenumber").alias("node")).agg(F.max((F.col("l_linenumber") == 1).cast("int")).alias("is_target"))
    return L.step_candidates(el, "step", "operation", 2).select("step", "operation", "node", "place")
