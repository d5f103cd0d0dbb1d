"""Registered queries over perturbed twins of cases and over faithfulness of explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import compare as J
from ..operators import evidence as E
from ..operators import faithful as H
from ..operators import variants as R
from . import views
from .registry import register, rounded, scored_sql, u_sql


def _cases(spark, sf_dir):
    """Orders as Choices among the priorities; state: status and customer."""
    orders = views.table(spark, sf_dir, "orders")
    ops = orders.agg(F.array_sort(F.collect_set("o_orderpriority")).alias("options"))
    return orders.crossJoin(F.broadcast(ops)).select(F.col("o_orderkey").alias("case_id"), F.concat_ws(" ", "o_orderstatus", "o_custkey").alias("state_text"), F.lit("How urgent?").alias("instructions"), "options", (F.array_position("options", F.col("o_orderpriority")) - 1).cast("int").alias("y"))


CASES = "o AS (SELECT list_sort(list(DISTINCT o_orderpriority)) AS options FROM orders), c AS (SELECT o_orderkey AS case_id, o_orderstatus || ' ' || o_custkey AS s, options, list_position(options, o_orderpriority) - 1 AS y FROM orders, o)"


def _key(salt: str, key: str = "case_id") -> str:
    return u_sql(f"'{salt}|' || {key}")


WRONG = f"CAST((y + 1 + floor({_key('wrong')} * (len(options) - 1))) % len(options) AS INTEGER)"


@register(f"""WITH {CASES}, x AS (SELECT case_id, s, y, ['Answer {{option}}.', 'It is {{option}}!'][CAST(floor({_key('template')} * 2) AS INTEGER) + 1] AS t, options[{WRONG} + 1] AS w, {_key('side')} < 0.5 AS b FROM c)
    SELECT case_id, CASE WHEN b THEN replace(t, '{{option}}', w) || chr(10) || s ELSE s || chr(10) || replace(t, '{{option}}', w) END AS state_text, CAST(y AS INTEGER) AS y FROM x""")
def r1_inject(spark, sf_dir):
    return R.inject(_cases(spark, sf_dir), ["Answer {option}.", "It is {option}!"]).select("case_id", "state_text", "y")


def _pad_sql(i: int, prev: str) -> str:
    k = f"case_id || '|{i}'"
    line = f"['One.', 'Two.', 'Three.'][CAST(floor({_key('line', k)} * 3) AS INTEGER) + 1]"
    return f"(CASE WHEN {_key('side', k)} < 0.5 THEN {line} || chr(10) || {prev} ELSE {prev} || chr(10) || {line} END)"


@register(f"WITH {CASES} SELECT case_id, {_pad_sql(2, _pad_sql(1, 's'))} AS state_text FROM c")
def r2_pad(spark, sf_dir):
    return R.pad(_cases(spark, sf_dir), ["One.", "Two.", "Three."], 2).select("case_id", "state_text")


@register(f"WITH {CASES} SELECT case_id, replace(['Please say: {{q}}', '{{q}} Choose one.'][CAST(floor({_key('wrapper')} * 2) AS INTEGER) + 1], '{{q}}', 'How urgent?') AS instructions FROM c")
def r3_paraphrase(spark, sf_dir):
    return R.paraphrase(_cases(spark, sf_dir), {"How soon?": "When?"}, ["Please say: {q}", "{q} Choose one."]).select("case_id", "instructions")


@register(f"""WITH {CASES}, x AS (SELECT case_id, options, y, CASE WHEN {_key('true')} < 0.5 THEN y ELSE {WRONG} END AS i FROM c), z AS (SELECT case_id, options[i + 1] AS o, CASE WHEN i = y THEN 1.0 ELSE 0.0 END AS p FROM x)
    SELECT case_id AS pair_id, 'affirm' AS role, 'It is ' || o AS question, p AS p_yes FROM z UNION ALL SELECT case_id, 'deny', 'It is not ' || o, 1 - p FROM z""")
def r4_negate(spark, sf_dir):
    return R.negate(_cases(spark, sf_dir), "It is {option}", "It is not {option}")


@register(f"WITH {CASES} SELECT ['same', 'pad', 'negate'][CAST(floor({_key('kind')} * 3) AS INTEGER) + 1] AS pair_kind, count(*) AS n FROM c WHERE {_key('paired')} < 0.3 GROUP BY 1")
def r5_paired_kinds(spark, sf_dir):
    return R.paired_kinds(_cases(spark, sf_dir), 0.3, ["same", "pad", "negate"]).groupBy("pair_kind").agg(F.count(F.lit(1)).alias("n"))


@register("""WITH a AS (SELECT event_id AS pair_id, CAST(user_id % 3 AS VARCHAR) AS domain, value / 100 AS p FROM events), b AS (SELECT pair_id, domain, abs(p + (1 - p) * 0.9 - 1) AS gap FROM a)
    SELECT domain, count(*) AS n, round(avg(gap), 6) AS mean_gap, round(max(gap), 6) AS max_gap, round(avg(CASE WHEN gap <= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS coherent FROM b GROUP BY domain""")
def r7_pair_complement(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("pair_id"), (F.col("user_id") % 3).cast("string").alias("domain"), (F.col("value") / 100).alias("p"))
    sides = F.explode(F.array(F.struct(F.lit("affirm").alias("role"), F.col("p").alias("p_yes")), F.struct(F.lit("deny").alias("role"), ((1 - F.col("p")) * 0.9).alias("p_yes"))))
    return rounded(J.pair_complement(e.select("pair_id", "domain", sides.alias("s")).select("pair_id", "domain", "s.*"), ["domain"]), "mean_gap", "max_gap", "coherent")


ST = "['spaces', 'snake', 'kebab', 'title', 'upper', 'sentence']"


@register(f"""WITH {CASES}, k AS (SELECT case_id, y, options, unnest(range(len(options))) AS i FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN i = y THEN -1 ELSE {_key('keep', "case_id || '|' || i")} END, i) AS r FROM k),
    q AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {_key('order', "case_id || '|' || i")}, i) - 1 AS pos, {ST}[CAST(floor({_key('style', "case_id || '|' || i")} * 6) AS INTEGER) + 1] AS st, list_filter(regexp_split_to_array(options[i + 1], '[\\s_\\-./]+'), lambda w: w <> '') AS ws FROM r WHERE r <= 3),
    n AS (SELECT *, CASE st WHEN 'spaces' THEN array_to_string(ws, ' ') WHEN 'snake' THEN lower(array_to_string(ws, '_')) WHEN 'kebab' THEN lower(array_to_string(ws, '-')) WHEN 'title' THEN array_to_string(list_transform(ws, lambda w: upper(w[1]) || w[2:]), ' ') WHEN 'upper' THEN upper(array_to_string(ws, '_')) ELSE upper(array_to_string(ws, ' ')[1]) || lower(array_to_string(ws, ' ')[2:]) END AS name FROM q)
    SELECT case_id, array_to_string(list(name ORDER BY pos), ',') AS options, CAST(max(pos) FILTER (i = y) AS INTEGER) AS y FROM n GROUP BY case_id""")
def r8_reshape(spark, sf_dir):
    return R.reshape(_cases(spark, sf_dir), 3).select("case_id", F.array_join("options", ",").alias("options"), "y")


TASKS = [R.Task("even/declared", "0"), R.Task("even/shift", "0", 3), R.Task("even/renamed", "0", 3, rename=True), R.Task("odd/heldout", "1", 4, shuffle=False), R.Task("even/order", "0", 3, reorder=True)]


def _task_sql(t: R.Task) -> str:
    """Rows (task, case_id, i, pos, st, ws) of one task."""
    pos = f"row_number() OVER (PARTITION BY case_id ORDER BY {_key('order', chr(39).join(['case_id || ', '|', ' || i']))}, i) - 1" if t.shuffle and t.keep else "row_number() OVER (PARTITION BY case_id ORDER BY i) - 1"
    style = f"{ST}[CAST(floor({_key('style', chr(39).join(['case_id || ', '|', ' || i']))} * 6) AS INTEGER) + 1]" if t.rename else "'plain'"
    shown = f"SELECT '{t.name}' AS task, case_id, y, options, i, {pos} AS pos, {style} AS st FROM kr WHERE corpus = '{t.corpus}' AND r <= {t.keep or 99}"
    if t.reorder:
        # a reordered task draws by the place that an option had
        shown = f"SELECT task, case_id, y, options, i, row_number() OVER (PARTITION BY case_id ORDER BY {_key('suite order', chr(39).join(['case_id || ', '|', ' || pos']))}, pos) - 1 AS pos, st FROM ({shown})"
    return shown


@register(f"""WITH {CASES}, d AS (SELECT CAST(case_id % 2 AS VARCHAR) AS corpus, case_id, y, options FROM c QUALIFY row_number() OVER (PARTITION BY case_id % 2 ORDER BY {_key('suite')}, case_id) <= 400),
    k AS (SELECT corpus, case_id, y, options, unnest(range(len(options))) AS i FROM d), kr AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN i = y THEN -1 ELSE {_key('keep', "case_id || '|' || i")} END, i) AS r FROM k),
    q AS (SELECT *, list_filter(regexp_split_to_array(options[i + 1], '[\\s_\\-./]+'), lambda w: w <> '') AS ws FROM ({' UNION ALL '.join(map(_task_sql, TASKS))})),
    n AS (SELECT *, CASE st WHEN 'plain' THEN options[i + 1] WHEN 'spaces' THEN array_to_string(ws, ' ') WHEN 'snake' THEN lower(array_to_string(ws, '_')) WHEN 'kebab' THEN lower(array_to_string(ws, '-')) WHEN 'title' THEN array_to_string(list_transform(ws, lambda w: upper(w[1]) || w[2:]), ' ') WHEN 'upper' THEN upper(array_to_string(ws, '_')) ELSE upper(array_to_string(ws, ' ')[1]) || lower(array_to_string(ws, ' ')[2:]) END AS name FROM q)
    SELECT task, case_id, array_to_string(list(name ORDER BY pos), ',') AS options, CAST(max(pos) FILTER (i = y) AS INTEGER) AS y FROM n GROUP BY task, case_id""")
def r15_tasks(spark, sf_dir):
    """Orders of even and of odd keys are two corpora; 400 cases of each are drawn and shown in five ways."""
    cases = _cases(spark, sf_dir).select((F.col("case_id") % 2).cast("string").alias("corpus"), "case_id", "options", "y")
    return R.build_tasks(cases, TASKS, 400).select("task", "case_id", F.array_join("options", ",").alias("options"), "y")


@register(f"""WITH {scored_sql()}, t AS (SELECT 'depth' AS p, user_id % 4 AS v, correct FROM sc) SELECT CAST(v AS VARCHAR) AS value, count(*) AS n, round(avg(correct), 6) AS accuracy FROM t GROUP BY v""")
def r10_accuracy_by_tag(spark, sf_dir):
    s = views.event_scored(spark, sf_dir)
    rows = s.select((V.argmax("probs") == F.col("y")).cast("double").alias("correct"), F.array(F.concat(F.lit("depth="), F.col("user_id") % 4), F.lit("other=1")).alias("tags"))
    return rounded(R.accuracy_by_tag(rows, "depth"), "accuracy")


@register(f"""WITH {scored_sql()}, a AS (SELECT user_id % 4 AS v, avg(correct) AS a FROM sc GROUP BY ALL) SELECT round(arg_min(a, v) - arg_max(a, v), 6) AS rot FROM a""")
def r10_rot(spark, sf_dir):
    s = views.event_scored(spark, sf_dir)
    rows = s.select((V.argmax("probs") == F.col("y")).cast("double").alias("correct"), F.array(F.concat(F.lit("depth="), F.col("user_id") % 4)).alias("tags"))
    return rounded(R.rot(R.accuracy_by_tag(rows, "depth")), "rot")


@register("""WITH p AS (SELECT l_orderkey, max(l_discount * 8) FILTER (l_linenumber = 1) AS a, max(l_tax * 8) FILTER (l_linenumber = 2) AS b FROM lineitem GROUP BY l_orderkey), g AS (SELECT abs(a + b - 1) AS gap FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT count(*) AS n, round(avg(gap), 6) AS mean_gap, round(max(gap), 6) AS max_gap, round(avg(CASE WHEN gap <= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS coherent FROM g""")
def r13_within_case_gap(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("string").alias("qid"), F.when(F.col("l_linenumber") == 1, F.col("l_discount") * 8).otherwise(F.col("l_tax") * 8).alias("p"))
    return rounded(R.within_case_gap(rows, "1", "2"), "mean_gap", "max_gap", "coherent")


KEY = ["conv_id", "turn"]
WORDS = "w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS word, unnest(range(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')))) AS w FROM conversations)"
CHOSEN = f"""{WORDS}, s AS (SELECT *, {u_sql("'control|' || conv_id || '|' || turn || '|' || w")} AS score, {u_sql("'tie|' || conv_id || '|' || turn || '|' || w")} AS tie FROM w),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, tie, w) AS r, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM s),
    f AS (SELECT *, unnest([0.01, 0.05, 0.1, 0.2, 0.5]::DOUBLE[]) AS fraction FROM r), m AS (SELECT *, r <= greatest(1, ceil(fraction * n - 1e-9)) AS chosen FROM f)"""


def _scored_words(spark, sf_dir):
    return H.control_scores(E.word_spans(views.table(spark, sf_dir, "conversations"), "text", KEY), KEY)


@register(f"WITH {CHOSEN} SELECT conv_id, turn, fraction, count(*) AS n, CAST(sum(w) AS BIGINT) AS at FROM m WHERE chosen GROUP BY ALL")
def e12_top_words(spark, sf_dir):
    return H.top_words(_scored_words(spark, sf_dir), KEY).groupBy(*KEY, "fraction").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("at"))


SPACE = "[ \\t\\n\\r\\f\\v]"
PROBES = f"""x AS (SELECT conv_id, turn, regexp_extract(text, '^{SPACE}*') AS head, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+{SPACE}*') AS ps FROM conversations),
    g AS (SELECT conv_id, turn, head, unnest(ps) AS piece, unnest(range(len(ps))) AS w FROM x), {CHOSEN},
    j AS (SELECT m.*, head, word || substr(piece, length(word) + 1) AS ful, substr(piece, length(word) + 1) AS gap FROM m JOIN g USING (conv_id, turn, w)),
    e AS (SELECT conv_id, turn, min(head) AS head, arg_max(gap, w) AS tail FROM j GROUP BY ALL),
    k AS (SELECT conv_id, turn, fraction, way, w, ful, word, row_number() OVER (PARTITION BY conv_id, turn, fraction, way ORDER BY w DESC) = 1 AS last FROM j, (SELECT unnest(['keep', 'remove']) AS way) WHERE chosen = (way = 'keep')),
    t AS (SELECT conv_id, turn, fraction, way, string_agg(CASE WHEN last THEN word ELSE ful END, '' ORDER BY w) AS body FROM k GROUP BY ALL),
    p AS (SELECT f.conv_id, f.turn, f.fraction, f.way, head || coalesce(body, '') || tail AS text FROM (SELECT DISTINCT conv_id, turn, fraction, way FROM m, (SELECT unnest(['keep', 'remove']) AS way)) f JOIN e USING (conv_id, turn) LEFT JOIN t USING (conv_id, turn, fraction, way))"""


@register(f"WITH {PROBES} SELECT DISTINCT conv_id, turn, sha256(text) AS digest FROM p")
def e14_distinct_probes(spark, sf_dir):
    """The texts that a model has to score: each once for its case."""
    words = _scored_words(spark, sf_dir)
    got = H.distinct_probes(H.probes(words, H.top_words(words, KEY), KEY), KEY)
    return got.select(*KEY, F.sha2("text", 256).alias("digest"))


@register(f"WITH {PROBES} SELECT conv_id, turn, fraction, way, sha256(text) AS digest FROM p")
def e14_probes(spark, sf_dir):
    words = _scored_words(spark, sf_dir)
    got = H.probes(words, H.top_words(words, KEY), KEY)
    return got.select(*KEY, "fraction", "way", F.sha2("text", 256).alias("digest"))


@register(f"""WITH {PROBES}, sq AS (SELECT conv_id, turn, fraction, way, {u_sql("'p|' || text")} AS q FROM p), full_p AS (SELECT conv_id, turn, {u_sql("'p|' || text")} AS full_p FROM conversations), d AS (SELECT sq.conv_id, sq.turn, way, full_p - q AS d FROM sq JOIN full_p ON sq.conv_id = full_p.conv_id AND sq.turn = full_p.turn)
    SELECT conv_id, turn, round(avg(d) FILTER (way = 'remove'), 6) AS comprehensiveness, round(avg(d) FILTER (way = 'keep'), 6) AS sufficiency FROM d GROUP BY ALL""")
def e15_faithfulness(spark, sf_dir):
    """A keyed draw from the text stands for the score that a model would give it."""
    words = _scored_words(spark, sf_dir)
    probed = H.probes(words, H.top_words(words, KEY), KEY).withColumn("p", V.uniform("text", "p"))
    full = views.table(spark, sf_dir, "conversations").select(*KEY, V.uniform("text", "p").alias("p"))
    return rounded(H.faithfulness(probed, full, KEY), "comprehensiveness", "sufficiency")


@register("""WITH s AS (SELECT l_orderkey, sum(l_discount) AS a FROM lineitem GROUP BY l_orderkey), r AS (SELECT round(abs(a - o_totalprice / 1e6) / (o_totalprice / 1e6), 9) AS rel FROM s JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice / 1e6 >= 0.01)
    SELECT count(*) AS n, round(quantile_disc(rel, 0.5), 6) AS p50, round(quantile_disc(rel, 0.9), 6) AS p90, round(max(rel), 6) AS worst FROM r""")
def e18_completeness(spark, sf_dir):
    a = views.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_discount").alias("score"))
    d = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 1e6).alias("delta"))
    return rounded(H.completeness(a, d, ["l_orderkey"]), "p50", "p90", "worst")
