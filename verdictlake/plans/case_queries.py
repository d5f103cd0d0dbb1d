"""Registered queries over case building, sampling, evidence tables and lexical decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import calibration as K
from ..operators import cases as C
from ..operators import compare as J
from ..operators import evidence as E
from ..operators import faithful as H
from ..operators import retrieval, splits
from . import views
from .catalog import MARKS
from .registry import draw_sql, register, rounded, scored_sql, tokens_sql, u_sql


@register("""WITH r AS (SELECT l_orderkey, l_linenumber, [CASE WHEN l_quantity < 6 THEN CAST(l_quantity AS INTEGER) END, CAST(l_discount * 100 AS INTEGER)] AS v FROM lineitem), k AS (SELECT * FROM r WHERE v[1] BETWEEN 0 AND 4 AND v[2] BETWEEN 0 AND 4),
    u AS (SELECT l_orderkey, l_linenumber, unnest(['q', 'd']) AS qid, unnest(v) AS y FROM k) SELECT qid, y, count(*) AS n FROM u GROUP BY ALL""")
def c3_score_cases(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") < 6, F.col("l_quantity")).alias("q"), F.round(F.col("l_discount") * 100).alias("d"))
    return C.score_cases(li, ["l_orderkey", "l_linenumber"], ["q", "d"], 5).groupBy("qid", "y").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT p_partkey, 'P_NAME:' || chr(10) || p_name || chr(10) || chr(10) || 'P_SIZE:' || chr(10) || p_size AS state_text FROM part")
def c4_render_fields(spark, sf_dir):
    return C.render_fields(views.table(spark, sf_dir, "part"), ["p_name", "p_size"]).select("p_partkey", "state_text")


@register("""WITH g AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_returnflag) AS fs FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, array_to_string(list_transform(fs, lambda f: list_position(['A', 'N'], f) - 1), ',') AS ratings FROM g WHERE NOT list_contains(fs, 'R')""")
def c9_split_judgements(spark, sf_dir):
    """An order's return flags as judgements joined by a sign; R isn't declared."""
    g = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_returnflag")), "#").alias("text"))
    return C.split_judgements(g, "text", ["A", "N"]).select("l_orderkey", F.array_join(F.col("ratings").cast("array<string>"), ",").alias("ratings"))


@register("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def c21_exclude_entities(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    return C.exclude_entities(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "o_custkey").select("o_orderkey")


@register(f"""WITH r AS (SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 200000 THEN 1 ELSE 2 END AS y FROM orders) SELECT o_orderkey, CASE WHEN {draw_sql('noise', 'o_orderkey')} < 0.1 THEN (y + 1) % 3 ELSE y END AS y FROM r""")
def c22_rule_labels(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    rule = F.when(F.col("o_totalprice") < 100000, "low").when(F.col("o_totalprice") < 200000, "mid").otherwise("high")
    return C.rule_label_cases(o, "o_orderkey", rule, ["low", "mid", "high"], 0.1).select("o_orderkey", "y")


@register(f"""WITH x AS (SELECT list_sort(list(DISTINCT o_orderpriority)) AS ops FROM orders), c AS (SELECT o_orderkey AS k, ops, list_position(ops, o_orderpriority) - 1 AS y FROM orders, x),
    d AS (SELECT k, ops, y, {draw_sql('truth', 'k')} < 0.5 AS t, CAST((y + 1 + floor({draw_sql('other', 'k')} * (len(ops) - 1))) % len(ops) AS INTEGER) AS o FROM c WHERE {draw_sql('pick', 'k')} < 0.4)
    SELECT k AS o_orderkey, 'Is the answer ' || ops[CASE WHEN t THEN y ELSE o END + 1] || '?' AS question, CASE WHEN t THEN 1 ELSE 0 END AS y FROM d""")
def c25_noul_from_choice(spark, sf_dir):
    got = C.text_choice_cases(views.table(spark, sf_dir, "orders").withColumn("key", F.col("o_orderkey").cast("string")), "key", "o_orderpriority", "o_orderstatus")
    return C.noul_from_choice(got.withColumn("o_orderkey", F.col("state_text").cast("long")), 0.4, "o_orderkey")


@register(f"""WITH k AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber FROM lineitem) SELECT l_orderkey, l_returnflag, l_linenumber FROM k QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {u_sql("'one|' || l_orderkey || '|' || l_linenumber")}, l_linenumber) = 1""")
def p8_one_per_case(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber").distinct()
    return splits.one_per_case(rows, "l_orderkey", "l_returnflag", "l_linenumber")


@register("SELECT event_type, user_id, event_id FROM (SELECT event_type, user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1) ORDER BY event_id, user_id LIMIT 20")
def p9_first_per_group(spark, sf_dir):
    return splits.first_per_group(views.table(spark, sf_dir, "events").select("event_type", "user_id", "event_id"), "user_id", "event_id", 20)


@register("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def p14_pending(spark, sf_dir):
    done = views.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return splits.pending(views.table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@register(f"""WITH g AS (SELECT greatest(1, ceil(count(*) / 256)) AS g FROM documents), w AS (SELECT doc_id, n_chars, floor({draw_sql('batch', 'doc_id')} * g) AS w FROM documents, g), p AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n_chars NULLS FIRST, doc_id) - 1 AS p FROM w) SELECT doc_id, CAST(w AS BIGINT) || '-' || CAST(floor(p / 16) AS BIGINT) AS batch FROM p""")
def p11_bucket_batches(spark, sf_dir):
    return splits.bucket_batches(views.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 16, 256).select("doc_id", "batch")


@register(f"""WITH {MARKS}, c AS (SELECT conv_id, turn, count_if(g AND p) AS b, count_if(g) AS g, count_if(p) AS p, count(*) AS n FROM m GROUP BY ALL), r AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE b / p END AS pr, b / g AS re FROM c WHERE g > 0)
    SELECT count(*) AS n, round(avg(pr), 6) AS "precision", round(avg(re), 6) AS recall, round(avg(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END), 6) AS f1, round(avg(p / n), 6) AS highlighted, round(avg(g / n), 6) AS human FROM r""")
def e8_plausibility(spark, sf_dir):
    key = ["conv_id", "turn"]
    words = E.word_spans(views.table(spark, sf_dir, "conversations"), "text", key)
    at = F.concat_ws("-", "conv_id", "turn", "w")
    marks = words.withColumns({"gold": V.uniform(at, "g") < 0.3, "predicted": V.uniform(at, "p") < 0.3})
    return rounded(H.plausibility(E.token_prf(marks, key), marks, key), "precision", "recall", "f1", "highlighted", "human")


@register("""WITH w AS (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS w, role FROM conversations), t AS (SELECT regexp_replace(lower(w), '[^\\p{L}\\p{N}]', '', 'g') AS token, role = 'user' AS m FROM w)
    SELECT token, count(*) AS n, round(avg(CASE WHEN m THEN 1.0 ELSE 0.0 END), 6) AS rate FROM t WHERE token <> '' GROUP BY token HAVING count(*) >= 3 AND avg(CASE WHEN m THEN 1.0 ELSE 0.0 END) >= 0.5""")
def e9_lexicon(spark, sf_dir):
    """Words that mostly come from users."""
    words = E.word_spans(views.table(spark, sf_dir, "conversations"), "text", ["conv_id", "turn", "role"]).withColumn("mark", F.col("role") == "user")
    return rounded(E.fit_lexicon(words, "word", "mark"), "rate")


@register(f"""WITH p AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+|[0-9]+')) AS piece FROM conversations), b AS (SELECT floor({u_sql("'bucket|' || piece")} * 4096) AS b, count(*) AS n FROM p GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS pieces, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS collided FROM b""")
def x12_hash_collisions(spark, sf_dir):
    pieces = retrieval.piece_counts(views.table(spark, sf_dir, "conversations"), "text", 1, "[A-Za-z]+|[0-9]+")
    return rounded(retrieval.hash_collisions(pieces, "piece", 4096), "collided")


@register(f"""WITH o AS (SELECT item_id AS idx, text FROM benchmark), {tokens_sql('t', 'o', 'idx')}, tf AS (SELECT idx, token, count(*) AS tf FROM t GROUP BY ALL), z AS (SELECT idx, CAST(sum(tf) AS BIGINT) AS size FROM tf GROUP BY idx), d AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
    SELECT idx, token, tf, size, df, (SELECT count(*) FROM o) AS n, round((SELECT sum(tf) FROM tf) / (SELECT count(*) FROM o), 6) AS avg_len FROM tf JOIN z USING (idx) JOIN d USING (token)""")
def x6_option_index(spark, sf_dir):
    """The whole inverted index with its totals."""
    postings, totals = retrieval.option_index(views.items(spark, sf_dir))
    return rounded(postings.crossJoin(F.broadcast(totals)), "avg_len")


X8 = f"""WITH o AS (SELECT item_id AS idx, text FROM benchmark), {tokens_sql('t', 'o', 'idx')}, tf AS (SELECT idx, token, count(*) AS tf FROM t GROUP BY ALL), sz AS (SELECT idx, count(*) AS sz FROM t GROUP BY idx), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
    st AS (SELECT (SELECT count(*) FROM o) AS n, (SELECT count(*) FROM t) / (SELECT count(*) FROM o) AS av),
    s AS (SELECT a.idx AS qid, b.idx, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * b.tf * 2.2 / (b.tf + 1.2 * (0.25 + 0.75 * sz / av))), 9) AS score FROM tf a JOIN tf b USING (token) JOIN sz ON sz.idx = b.idx JOIN df USING (token), st GROUP BY ALL),
    r AS (SELECT x.idx AS qid, o.idx, row_number() OVER (PARTITION BY x.idx ORDER BY score DESC NULLS LAST, o.idx) AS rank FROM o x CROSS JOIN o LEFT JOIN s ON s.qid = x.idx AND s.idx = o.idx)"""


@register(f"{X8} SELECT count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM r WHERE qid = idx")
def x8_recall(spark, sf_dir):
    """How often a passage is in the best five for its own text."""
    items = views.items(spark, sf_dir)
    best = retrieval.bm25_shortlist(items.withColumnRenamed("idx", "qid"), items, 5)
    return rounded(retrieval.recall_at_k(best, items.select(F.col("idx").alias("qid"), "idx")), "recall")


@register(f"""WITH {scored_sql('a')}, {scored_sql('b', 'v', 0.6)}, u AS (SELECT 'a' AS system, domain, correct FROM a UNION ALL SELECT 'b', domain, correct FROM b), s AS (SELECT system, domain, avg(correct) AS accuracy FROM u GROUP BY ALL) SELECT system, round(avg(accuracy), 6) AS accuracy, count(*) AS slices FROM s GROUP BY system""")
def j14_macro(spark, sf_dir):
    """Unweighted mean over slices of each system."""
    both = [K.with_confidence(views.event_scored(spark, sf_dir, s, k)).select(F.lit(n).alias("system"), F.col("domain").alias("slice"), "correct") for n, s, k in (("a", "l", 1.2), ("b", "v", 0.6))]
    each = both[0].unionByName(both[1]).groupBy("system", "slice").agg(F.avg("correct").alias("accuracy"))
    return rounded(J.macro(each), "accuracy")


@register(f"""WITH {scored_sql()}, d AS (SELECT case_id, probs, y, list_sort(list_transform(range(5), lambda i: {{'u': {u_sql("'order|' || case_id || '|' || i")}, 'i': i}})) AS o FROM sc)
    SELECT case_id, array_to_string(list_transform(o, lambda s: ty[s.i + 1]), ',') AS options, CAST(list_position(list_transform(o, lambda s: s.i), y) - 1 AS INTEGER) AS y FROM d, sc_t""")
def r9_reorder(spark, sf_dir):
    s = views.event_scored(spark, sf_dir).withColumn("options", F.col("labels"))
    return J.reorder(s).select("case_id", F.array_join("options", ",").alias("options"), "y")


@register(f"""WITH {scored_sql('a')}, {scored_sql('b', 'v', 0.6)}, d AS (SELECT a.brier - b.brier AS d FROM a JOIN b USING (case_id)) SELECT count(*) AS n, round(avg(d), 6) AS mean, round(1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS half_width FROM d""")
def e16_paired_ci(spark, sf_dir):
    a, b = (K.with_confidence(views.event_scored(spark, sf_dir, s, k)) for s, k in (("l", 1.2), ("v", 0.6)))
    return rounded(E.paired_ci(a, b, ["case_id"], "brier"), "mean", "half_width")
