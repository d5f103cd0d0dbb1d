"""Registered queries over user scorers and tokenizers, interval sweeps, stored sketches, and reports beside them."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import bootstrap as B
from ..operators import calibration as K
from ..operators import cases as C
from ..operators import compare as J
from ..operators import evidence as E
from ..operators import faithful as H
from ..operators import gates, loaders, retrieval, scoring
from ..operators import teacher as T
from ..sources.shared import shared_path
from . import views
from .registry import draw_sql, register, rounded, scored_sql, tokens_sql

KEY = ["conv_id", "turn"]


# ---- a user's model and tokenizer ---------------------------------------------------------------


class PaddedScorer:
    """Stands for a user's model: a batch is one padded matrix, and padding takes no part in an answer."""

    def __call__(self, rows: pd.DataFrame) -> list[np.ndarray]:
        n = rows["n"].to_numpy()
        at = np.arange(n.max())
        z = np.where(at < n[:, None], rows["value"].to_numpy()[:, None] / 100 * (at + 1) - rows["size"].to_numpy()[:, None] / 10 * at, 0.0)
        return [row[:k] for row, k in zip(z, n)]


@register("""WITH q AS (SELECT event_id, value, length(props) AS size, 2 + user_id % 3 AS n FROM events) SELECT event_id, i AS idx, round(value / 100 * (i + 1) - size / 10 * i, 6) AS logit, CAST(0 AS INTEGER) AS faults FROM (SELECT *, unnest(range(n)) AS i FROM q)""")
def u1_score_with(spark, sf_dir):
    """Events as questions of two to four labels, in batches of at most 20,000 rows times squared length."""
    q = views.table(spark, sf_dir, "events").select("event_id", "value", F.length("props").alias("size"), (2 + F.col("user_id") % 3).cast("int").alias("n"))
    out = scoring.score_with(q, PaddedScorer, "size", "n", budget=20_000)
    return out.select("event_id", F.posexplode("logits").alias("idx", "logit"), F.size("reasons").alias("faults")).select("event_id", F.col("idx").cast("long").alias("idx"), F.round("logit", 6).alias("logit"), "faults")


PIECES = r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"


def piece_counter():
    piece = re.compile(PIECES, re.ASCII)
    return lambda texts: [len(piece.findall(t)) for t in texts]


@register("""WITH s AS (SELECT item_id, 'Is this about it?' AS header, text FROM benchmark), p AS (SELECT item_id, unnest([header, text]) AS t FROM s) SELECT item_id, CAST(sum(len(regexp_extract_all(coalesce(t, ''), '[A-Za-z0-9]+|[^A-Za-z0-9 \\t\\n\\r\\f\\v]'))) AS BIGINT) AS tokens FROM p GROUP BY item_id""")
def d13_exact_tokens(spark, sf_dir):
    """Header and text of every item under a tokenizer of words and signs."""
    items = views.table(spark, sf_dir, "benchmark")
    return scoring.exact_tokens(items, piece_counter, F.array(F.lit("Is this about it?"), F.col("text"))).select("item_id", "tokens")


# ---- stored option sets -----------------------------------------------------------------------------


def _set_sql(name: str, options: str) -> str:
    """CTEs of the best three options of one set for every turn."""
    return f"""{name}_o AS ({options}), {tokens_sql(f'{name}_t', f'{name}_o', 'idx')}, {name}_tf AS (SELECT idx, token, count(*) AS tf FROM {name}_t GROUP BY ALL), {name}_sz AS (SELECT idx, count(*) AS sz FROM {name}_t GROUP BY idx), {name}_df AS (SELECT token, count(*) AS df FROM {name}_tf GROUP BY token),
    {name}_s AS (SELECT qid, idx, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sz / av))), 9) AS score FROM (SELECT DISTINCT qid, token FROM q) JOIN {name}_tf USING (token) JOIN {name}_sz USING (idx) JOIN {name}_df USING (token), (SELECT (SELECT count(*) FROM {name}_o) AS n, (SELECT count(*) FROM {name}_t) / (SELECT count(*) FROM {name}_o) AS av) GROUP BY ALL),
    {name}_l AS (SELECT qid, idx FROM turns, (SELECT unnest(range(3)) AS idx)), {name}_a AS (SELECT coalesce(s.qid, l.qid) AS qid, coalesce(s.idx, l.idx) AS idx, score FROM {name}_s s FULL JOIN {name}_l l ON l.qid = s.qid AND l.idx = s.idx),
    {name}_r AS (SELECT '{name}' AS name, qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, idx) AS rank, idx, score FROM {name}_a)"""


@register(f"""WITH turns AS (SELECT conv_id * 1000 + turn AS qid, text FROM conversations), {tokens_sql('q', 'turns', 'qid')}, {_set_sql('items', 'SELECT item_id AS idx, text FROM benchmark')}, {_set_sql('parts', "SELECT p_partkey AS idx, p_name || ' ' || p_brand AS text FROM part")}
    SELECT name, qid, CAST(rank AS INTEGER) AS rank, idx, round(score, 6) AS score FROM (FROM items_r UNION ALL FROM parts_r) WHERE rank <= 3""")
def x6_stored_index(spark, sf_dir):
    """Two option sets in one store, indexed once; the second time they are found by key. Every turn asks both, of which a token is frequent in the larger one."""
    items = views.items(spark, sf_dir).select(F.lit("items").alias("name"), F.col("idx").cast("long").alias("idx"), "text")
    parts = views.table(spark, sf_dir, "part").select(F.lit("parts").alias("name"), F.col("p_partkey").alias("idx"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    store = retrieval.OptionStore(spark, shared_path(spark, "options"))
    store.ensure(items.unionByName(parts), "name")
    keys = store.ensure(items.unionByName(parts), "name")
    turns = views.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    best = store.shortlist(turns, 3, frequent=64, sets=keys)
    return rounded(best.join(keys, "set_key").select("name", "qid", "rank", "idx", "score"), "score")


# ---- sketches -------------------------------------------------------------------------------------


@register(f"""WITH {scored_sql()} SELECT domain, count(*) AS n, true AS cases_close, true AS ranks_close FROM sc GROUP BY domain""")
def k21_merged_sketches(spark, sf_dir):
    """Sketches stored a day at a time, merged over all days, and whether they are within their bounds of the exact figures."""
    s = views.event_scored(spark, sf_dir).withColumn("day", F.to_date("ts"))
    merged = K.approximate_report(K.daily_sketches(s, ["domain"], "day"), ["domain"])
    exact = K.with_confidence(s).groupBy("domain").agg(F.count_distinct("case_id").alias("_cases"), F.count(F.lit(1)).alias("_n"))
    below = K.with_confidence(s).join(merged.select("domain", "quantiles"), "domain").groupBy("domain").agg(*[(F.avg((F.col("conf") <= F.col("quantiles")[i] + 1e-9).cast("double"))).alias(f"_r{i}") for i in range(3)])
    both = merged.join(exact, "domain").join(below, "domain")
    ranks = [F.abs(F.col(f"_r{i}") - q) <= 0.02 for i, q in enumerate((0.05, 0.5, 0.95))]
    return both.where("n = _n").select("domain", "n", (F.abs(F.col("cases") / F.col("_cases") - 1) <= 0.05).alias("cases_close"), (ranks[0] & ranks[1] & ranks[2]).alias("ranks_close"))


# ---- words and spans --------------------------------------------------------------------------------

WS = "[ \\t\\n\\r\\f\\v]"
TURN = "conv_id || '|' || turn"
WORDS = f"""x AS (SELECT conv_id, turn, text, length(regexp_extract(text, '^{WS}*')) AS lead, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+{WS}*') AS ps FROM conversations), u AS (SELECT conv_id, turn, lead, unnest(ps) AS piece, unnest(range(len(ps))) AS w FROM x),
    ws AS (SELECT conv_id, turn, w, lead + sum(length(piece)) OVER (PARTITION BY conv_id, turn ORDER BY w) - length(piece) AS a, length(regexp_extract(piece, '^[^ \\t\\n\\r\\f\\v]+')) AS n FROM u),
    sp AS (SELECT conv_id, turn, a, a + CAST(floor({draw_sql('reach', TURN + " || '|' || i")} * 12) AS BIGINT) AS z, round({draw_sql('weight', TURN + " || '|' || i")}, 6) AS score FROM
      (SELECT conv_id, turn, i, CAST(floor({draw_sql('place', TURN + " || '|' || i")} * length(text)) AS BIGINT) AS a FROM conversations, (SELECT unnest(range(4)) AS i)))"""


def _words(spark, sf_dir):
    return E.word_spans(views.table(spark, sf_dir, "conversations"), "text", KEY)


def _spans(spark, sf_dir):
    """Four drawn spans of up to eleven characters in every turn, some of them empty."""
    c = views.table(spark, sf_dir, "conversations").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    key = F.concat_ws("|", *KEY, "i")
    start = F.floor(V.uniform(key, "place") * F.length("text"))
    return c.select(*KEY, start.alias("start"), (start + F.floor(V.uniform(key, "reach") * 12)).alias("end"), F.round(V.uniform(key, "weight"), 6).alias("score"))


@register(f"WITH {WORDS} SELECT ws.conv_id, ws.turn, ws.w, count(sp.a) > 0 AS touched FROM ws LEFT JOIN sp ON ws.conv_id = sp.conv_id AND ws.turn = sp.turn AND sp.a < ws.a + n AND ws.a < sp.z GROUP BY ALL")
def j10_span_overlap(spark, sf_dir):
    return E.span_overlap(_words(spark, sf_dir), _spans(spark, sf_dir), KEY, "touched").select(*KEY, F.col("w").cast("long").alias("w"), "touched")


@register(f"WITH {WORDS}, m AS (SELECT DISTINCT ws.conv_id, ws.turn, ws.w FROM ws JOIN sp ON ws.conv_id = sp.conv_id AND ws.turn = sp.turn AND sp.a < ws.a + n AND ws.a < sp.z) SELECT conv_id, turn, count(*) AS marked, CAST(sum(w) AS BIGINT) AS at FROM m GROUP BY ALL")
def e5_highlighted(spark, sf_dir):
    words = E.highlighted(_words(spark, sf_dir), _spans(spark, sf_dir), KEY).where("marked")
    return words.groupBy(*KEY).agg(F.count(F.lit(1)).alias("marked"), F.sum("w").alias("at"))


@register(f"""WITH {WORDS}, tk AS (SELECT conv_id, turn, i AS w, 5 * i AS s, least(5 * i + 5, length(text)) AS z0, substr(text, 5 * i + 1, 5) AS piece FROM (SELECT conv_id, turn, text, unnest(range(CAST(ceil(length(text) / 5) AS BIGINT))) AS i FROM conversations)),
    t AS (SELECT *, s + length(regexp_extract(piece, '^{WS}*')) AS a FROM tk)
    SELECT t.conv_id, t.turn, t.w, CAST(CASE WHEN count(sp.a) > 0 THEN 1 ELSE 0 END AS INTEGER) AS label FROM t LEFT JOIN sp ON t.conv_id = sp.conv_id AND t.turn = sp.turn AND sp.a < t.z0 AND t.a < sp.z AND t.a < t.z0 GROUP BY ALL""")
def e4_token_labels(spark, sf_dir):
    """Pieces of five characters as tokens."""
    c = views.table(spark, sf_dir, "conversations").where("length(text) > 0")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / 5) - 1), lambda i: F.struct(i.alias("w"), (5 * i).alias("start"), F.least(5 * i + 5, F.length("text")).alias("end")))
    tokens = c.select(*KEY, "text", F.explode(cut).alias("t")).select(*KEY, "text", "t.*")
    return E.token_labels(tokens, _spans(spark, sf_dir), KEY).select(*KEY, "w", "label")


@register(f"WITH {WORDS} SELECT ws.conv_id, ws.turn, ws.w, coalesce(max(sp.score), 0) AS score FROM ws LEFT JOIN sp ON ws.conv_id = sp.conv_id AND ws.turn = sp.turn AND sp.a < ws.a + n AND ws.a < sp.z GROUP BY ALL")
def e11_word_scores(spark, sf_dir):
    return H.word_scores(_words(spark, sf_dir), _spans(spark, sf_dir), KEY).select(*KEY, F.col("w").cast("long").alias("w"), "score")


@register(f"""WITH x AS (SELECT conv_id, turn, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+') AS ps FROM conversations), u AS (SELECT conv_id, turn, unnest(range(len(ps))) AS w, regexp_replace(lower(unnest(ps)), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS t FROM x),
    m AS (SELECT *, {draw_sql('lex', "conv_id || '|' || turn || '|' || w")} < 0.5 AS g FROM u), l AS (SELECT t, avg(CASE WHEN g THEN 1.0 ELSE 0.0 END) AS rate FROM m GROUP BY t HAVING count(*) >= 3 AND avg(CASE WHEN g THEN 1.0 ELSE 0.0 END) >= 0.5 AND t <> '')
    SELECT conv_id, turn, w, round(coalesce(rate, 0), 6) AS score FROM m LEFT JOIN l USING (t)""")
def e17_lexicon_control(spark, sf_dir):
    """A lexicon of the words that drawn highlights mark at least half the time, as the control's score."""
    words = _words(spark, sf_dir)
    marked = words.withColumn("gold", V.uniform(F.concat_ws("|", *KEY, "w"), "lex") < 0.5)
    scored = H.control_scores(words, KEY, lexicon=E.fit_lexicon(marked, "word", "gold"))
    return scored.select(*KEY, F.col("w").cast("long").alias("w"), F.round("score", 6).alias("score"))


# ---- systems side by side ----------------------------------------------------------------------------

BOTH = f"{scored_sql('a')}, {scored_sql('b', 'v', 0.6)}"


def _systems(spark, sf_dir):
    return [views.event_scored(spark, sf_dir, s, k).withColumns({"decision": V.argmax("probs"), "confidence": F.array_max("probs")}) for s, k in (("l", 1.2), ("v", 0.6))]


@register(f"""WITH {BOTH} SELECT a.case_id, CAST(list_position(a.probs, list_max(a.probs)) - 1 AS INTEGER) AS decision, CAST(list_position(b.probs, list_max(b.probs)) - 1 AS INTEGER) AS theirs, round(list_max(a.probs), 6) AS confidence, round(list_max(b.probs), 6) AS their_confidence
    FROM a JOIN b USING (case_id) WHERE list_position(a.probs, list_max(a.probs)) <> list_position(b.probs, list_max(b.probs))""")
def j3_disagreements(spark, sf_dir):
    out = J.disagreements(*_systems(spark, sf_dir)).drop("qid")
    return rounded(out, "confidence", "their_confidence")


@register(f"""WITH {BOTH} SELECT a.domain, count(*) AS n, round(avg(CASE WHEN list_position(a.probs, list_max(a.probs)) = list_position(b.probs, list_max(b.probs)) THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM a JOIN b USING (case_id) GROUP BY a.domain""")
def j6_invariance(spark, sf_dir):
    """The second answers are given to options in a drawn order, and compared by name."""
    a, b = (s.withColumn("options", F.col("labels")) for s in _systems(spark, sf_dir))
    order = F.array_sort(F.transform("options", lambda x, i: F.struct(V.uniform(F.concat_ws("|", "case_id", i), "turned").alias("u"), i.alias("i"))))
    turned = b.withColumn("_o", order).withColumns({"options": F.transform("_o", lambda s: F.element_at("options", s["i"] + 1)), "probs": F.transform("_o", lambda s: F.element_at("probs", s["i"] + 1))})
    return rounded(J.invariance(a, turned, ["case_id"], ["domain"]), "agreement")


@register(f"""WITH {BOTH}, j AS (SELECT a.domain, a.probs AS p, b.probs AS q, length(props) AS t, value FROM a JOIN b USING (case_id) JOIN events ON event_id = case_id)
    SELECT domain, count(*) AS n, count(*) AS judged, round(avg(CASE WHEN list_position(p, list_max(p)) = list_position(q, list_max(q)) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, 1.0::DOUBLE AS mean_calls,
      round(avg(list_sum(list_transform(range(5), lambda i: q[i + 1] * ln(q[i + 1] / greatest(p[i + 1], 1e-12))))), 6) AS kl, round(avg(t), 6) AS mean_tokens, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.99), 6) AS p99 FROM j GROUP BY domain""")
def l12_workflow_report(spark, sf_dir):
    """A workflow of one step, with the second system's answers as its reference."""
    a, b = _systems(spark, sf_dir)
    worth = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("case_id"), F.length("props").alias("tokens"), F.col("value").alias("latency"))
    done = a.join(b.select("case_id", F.col("probs").alias("reference"), F.col("decision").alias("truth")), "case_id").join(worth, "case_id").withColumn("calls", F.lit(1))
    out = T.workflow_score(done, {"decision": "truth"}, ["domain"], {"probs": "reference"}, "tokens", "latency")
    return rounded(out, "accuracy", "mean_calls", "kl", "mean_tokens", "p50", "p99")


# ---- labels of annotators and teachers -------------------------------------------------------------------


@register(f"""WITH a AS (SELECT l_orderkey AS item, list(CAST(floor(l_quantity) AS BIGINT) % 5 ORDER BY l_linenumber, CAST(floor(l_quantity) AS BIGINT) % 5) AS vs FROM lineitem GROUP BY l_orderkey)
    SELECT item, CAST(len(vs) AS INTEGER) AS raters, array_to_string(list_transform(range(5), lambda k: CAST(len(list_filter(vs, lambda x: x = k)) AS VARCHAR)), ',') AS votes, CAST(vs[CAST(floor({draw_sql('rater', 'item')} * len(vs)) AS BIGINT) + 1] AS INTEGER) AS y FROM a WHERE len(vs) >= 2""")
def c5_annotated_cases(spark, sf_dir):
    """The lines of an order as its list of ratings."""
    rows = views.annotators(spark, sf_dir).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("rater", "rating"))).alias("r"))
    got = C.annotated_cases(rows.select("item", F.transform("r", lambda x: x["rating"]).alias("ratings")), "item", "ratings", 5)
    votes = F.transform("distribution", lambda d: F.round(d * F.col("raters")).cast("int").cast("string"))
    return got.select("item", "raters", F.array_join(votes, ",").alias("votes"), "y")


@register(f"""WITH {scored_sql()} SELECT case_id, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS y, round(list_max(probs), 6) AS top, true AS from_teacher FROM sc WHERE user_id % 4 <> 0""")
def c23_teacher_cases(spark, sf_dir):
    """Users divisible by four have a teacher that answered to other options, so their records drop."""
    s = views.event_scored(spark, sf_dir)
    records = s.select("case_id", "qid", "labels", F.when(F.col("user_id") % 4 == 0, F.reverse("labels")).otherwise(F.col("labels")).alias("options"), F.transform("probs", lambda p: F.ln(p)).alias("logprobs"))
    return T.teacher_cases(records).select("case_id", "y", F.round(F.array_max("distribution"), 6).alias("top"), "from_teacher")


@register(f"""WITH {scored_sql()}, e AS (SELECT case_id, user_id % 2 = 0 AS noul, user_id % 3 = 0 AS teacher, probs, y FROM sc)
    SELECT case_id, sha256('case ' || case_id || chr(10) || chr(10) || 'Which?') AS prompt, round(CASE WHEN teacher THEN list_max(probs) ELSE 1 END, 6) AS top, CASE WHEN teacher AND noul THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM e""")
def c27_examples(spark, sf_dir):
    """Every third user's answers are a teacher's, every second user's a yes/no."""
    s = views.event_scored(spark, sf_dir)
    taught = F.col("user_id") % 3 == 0
    cases = s.select("case_id", "qid", F.concat(F.lit("case "), F.col("case_id")).alias("state_text"), F.lit("Which?").alias("instructions"), F.col("labels").alias("options"), F.when(taught, F.col("probs")).alias("distribution"), "y", taught.alias("from_teacher"), F.when(F.col("user_id") % 2 == 0, "noul").otherwise("choice").alias("kind"))
    got = loaders.examples(cases, 0.25)
    return got.select("case_id", F.sha2("prompt", 256).alias("prompt"), F.round(F.array_max("target"), 6).alias("top"), "weight")


@register(f"""WITH {scored_sql()} SELECT case_id, round(1 / (1 + exp(-(logits[2] - logits[1]))), 6) AS p, round(1 / (1 + exp(-(logits[2] - logits[1]) / 0.5)), 6) AS sharp FROM sc""")
def d2_sigmoid(spark, sf_dir):
    x = F.col("logits")[1] - F.col("logits")[0]
    return views.event_scored(spark, sf_dir).select("case_id", F.round(V.sigmoid(x), 6).alias("p"), F.round(V.sigmoid(x, 0.5), 6).alias("sharp"))


@register(f"""WITH {scored_sql()}, b AS (SELECT case_id, CASE WHEN user_id % 5 = 0 THEN 1.5 ELSE 1.0 END AS total, CASE WHEN user_id % 7 = 0 THEN 9 ELSE y END AS y FROM sc) SELECT case_id FROM b WHERE total > 1 OR y > 4""")
def m10_unsound_rows(spark, sf_dir):
    """Every fifth user's probabilities sum to one and a half, every seventh user's labels are out of range."""
    s = views.event_scored(spark, sf_dir)
    bent = s.withColumns({"probs": F.when(F.col("user_id") % 5 == 0, F.transform("probs", lambda p: p * 1.5)).otherwise(F.col("probs")), "y": F.when(F.col("user_id") % 7 == 0, 9).otherwise(F.col("y"))})
    return K.check_scored(bent).select("case_id")


@register("""WITH s AS (SELECT event_type AS slice, avg(value) / 100 AS recall FROM events GROUP BY event_type), g AS (SELECT slice, unnest([{'gate': 'recall', 'value': recall, 'lim': 0.99::DOUBLE, 'ok': recall >= 0.99}, {'gate': 'injection_robustness', 'value': 1 - recall, 'lim': 0.1::DOUBLE, 'ok': 1 - recall <= 0.1}]) AS g FROM s)
    SELECT slice, g.gate AS gate, round(g.value, 6) AS value, g.lim AS "limit", g.ok AS passed, false AS advisory FROM g""")
def g13_recall_gate(spark, sf_dir):
    """Mean values in hundredths stand for a shortlist's recall."""
    s = views.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("slice")).agg((F.avg("value") / 100).alias("recall"))
    none = F.lit(None).cast("double")
    report = s.withColumns({"worst_lift": none, "worst_ece": none, "injection_drop": 1 - F.col("recall"), "ece_delta": none})
    return rounded(gates.slice_gates(report, ["slice"], require_per_question=True), "value")


@register("""WITH g AS (SELECT user_id, event_type AS gate, avg(value) >= 50 AS passed, event_type = (SELECT min(event_type) FROM events) AS advisory FROM events GROUP BY ALL)
    SELECT user_id, coalesce(bool_and(passed) FILTER (NOT advisory), true) AS passed, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (NOT advisory AND NOT passed), '') AS blocked FROM g WHERE NOT advisory GROUP BY user_id""")
def g14_verdict(spark, sf_dir):
    """Event types stand for gates, of which the first is advisory."""
    e = views.table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("_first"))
    rows = e.groupBy("user_id", F.col("event_type").alias("gate")).agg((F.avg("value") >= 50).alias("passed")).crossJoin(first).withColumn("advisory", F.col("gate") == F.col("_first"))
    return gates.verdict(rows, ["user_id"])


@register(f"""WITH {scored_sql()}, f AS (SELECT DISTINCT ON (case_id) case_id, domain, conf, correct FROM sc WHERE user_id % 6 <> 0) SELECT domain, count(*) AS n, round(avg(conf), 6) AS confidence FROM f GROUP BY domain""")
def k18_without_teachers(spark, sf_dir):
    """Answers whose label came from a teacher are left out before the guard, which would stop the job."""
    s = views.event_scored(spark, sf_dir).withColumn("from_teacher", F.col("user_id") % 6 == 0)
    kept = K.with_confidence(K.refuse_teacher(s.where("not from_teacher"), "a calibration fit"))
    return rounded(kept.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("confidence")), "confidence")


@register(f"""WITH {scored_sql()} SELECT case_id, i AS idx, round(ln(greatest(probs[i + 1], 1e-12)), 6) AS logit FROM sc, (SELECT unnest(range(5)) AS i)""")
def f14_log_probabilities(spark, sf_dir):
    s = B.logit_rows(views.event_scored(spark, sf_dir).drop("logits"))
    return s.select("case_id", F.posexplode("logits").alias("idx", "logit")).select("case_id", F.col("idx").cast("long").alias("idx"), F.round("logit", 6).alias("logit"))
