"""Twins, probes, loaders and teacher streams on rows whose answers are known by hand."""

import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from verdictlake.operators import evidence, faithful, loaders, teacher, variants
from verdictlake.plans import queries

CASE = "case_id long, state_text string, instructions string, options array<string>, y int, distribution array<double>"


@pytest.fixture
def cases(spark):
    names = ["late fee", "lost card", "new-account", "other"]
    return spark.createDataFrame([(i, f"text {i}", "Which?", names, i % 4, [0.1, 0.2, 0.3, 0.4]) for i in range(40)], CASE)


@pytest.mark.parametrize("parts", [1, 6])
def test_reshape_keeps_the_truth_and_follows_it(cases, parts):
    plain = variants.reshape(cases.repartition(parts), 2, rename=False).collect()
    names = ["late fee", "lost card", "new-account", "other"]
    for r in plain:
        assert len(r.options) == 2 and r.options[r.y] == names[r.case_id % 4]
        assert sum(r.distribution) == pytest.approx(1.0)
    ids = variants.reshape(cases, 3, criteria_only=True).first()
    assert ids.options == ["option_1", "option_2", "option_3"] and ids.criteria[ids.y] == names[ids.case_id % 4]


def test_colliding_names_stay_as_declared(spark):
    c = spark.createDataFrame([(i, "", "", ["a b", "a_b"], 0, None) for i in range(20)], CASE).drop("distribution")
    assert all(len(set(r.options)) == 2 for r in variants.reshape(c, 2).collect())


def test_injection_names_a_wrong_option(cases):
    for r in variants.inject(cases, ["say {option}"]).collect():
        line = next(x for x in r.state_text.split("\n") if x.startswith("say "))
        assert line[4:] in r.options and line[4:] != r.options[r.y]


def test_negation_pairs_are_complements(cases):
    rows = variants.negate(cases, "is {option}", "not {option}").groupBy("pair_id").agg(F.sum("p_yes").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert len(rows) == 40 and all((r.s, r.n) == (1.0, 2) for r in rows)


def test_probes_split_a_text_in_two(spark):
    docs = spark.createDataFrame([(1, "one two  three\nfour"), (2, "alone")], "id int, text string")
    words = evidence.word_spans(docs, "text", ["id"]).withColumn("score", F.col("w").cast("double"))
    got = {(r.id, r.fraction, r.way): r.text for r in faithful.probes(words, faithful.top_words(words, ["id"], (0.5,)), ["id"]).collect()}
    assert got == {(1, 0.5, "keep"): "three\nfour", (1, 0.5, "remove"): "one two", (2, 0.5, "keep"): "alone", (2, 0.5, "remove"): ""}


def test_probes_keep_head_gaps_and_tail(spark):
    words = evidence.word_spans(spark.createDataFrame([(1, "\n a  b\tc d \n")], "id int, text string"), "text", ["id"])
    assert [(r.start, r.end, r.word, r.gap, r.head) for r in words.orderBy("w").collect()] == [(2, 3, "a", "  ", "\n "), (5, 6, "b", "\t", ""), (7, 8, "c", " ", ""), (9, 10, "d", " \n", "")]
    chosen = spark.createDataFrame([(1, 0.5, 1), (1, 0.5, 3)], "id int, fraction double, w int")
    got = {r.way: r.text for r in faithful.probes(words, chosen, ["id"]).collect()}
    assert got == {"keep": "\n b\td \n", "remove": "\n a  c \n"}


def test_word_scores_take_the_highest_token_that_touches(spark):
    words = evidence.word_spans(spark.createDataFrame([(1, "ab cd ef")], "id int, text string"), "text", ["id"])
    tokens = spark.createDataFrame([(1, 0, 1, 0.2), (1, 1, 4, 0.7), (1, 3, 5, 0.4)], "id int, start int, end int, score double")
    assert [r.score for r in faithful.word_scores(words, tokens, ["id"]).orderBy("w").collect()] == [0.7, 0.7, 0.0]


def test_page_elements(spark):
    html = '<div role="menu"><a title="Go">to <b>it</b></a><img alt="pic"></div><p>x'
    rows = loaders.page_elements(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string"), "page_id").orderBy("node").collect()
    assert [(r.page_id, r.tag, r.label) for r in rows] == [(1, "div", "div menu to it"), (1, "a", 'a to it title="Go"'), (1, "b", "b it"), (1, "img", 'img alt="pic"'), (1, "p", "p x")]


def test_wire_questions(spark):
    body = '{"a":{"type":"choice","instructions":"I","criteria":{"x":"1"}},"b":{"type":"noul","instructions":"N"},"c":{"type":"score","instructions":"S","criteria":{"x":1}},"d":{"type":"noul"}}'
    got = {r.qid: (r.options, r.reason) for r in loaders.to_native(spark.createDataFrame([(1, body)], "k int, q string"), "k", "q").collect()}
    assert got == {"a": (["x"], None), "b": (["no", "yes"], None), "c": (None, "criteria must be an array"), "d": (None, "no instructions")}


def test_generated_cases_have_reasons(spark):
    good = '{"state":"s","questions":[{"kind":"noul","id":"a"}]}'
    rows = spark.createDataFrame([(1, f"x {good} y", ["noul"]), (2, "none", ["noul"]), (3, good, ["score"]), (4, good.replace('"a"', '"A b"'), ["noul"]), (5, "{broken}", ["noul"])], "k int, text string, planned array<string>")
    got = {r.k: r.reason for r in teacher.parse_generated(rows, "state string, questions array<struct<kind:string,id:string>>", "planned").collect()}
    assert got == {1: None, 2: "no object", 3: "kinds", 4: "id", 5: "not JSON"}


def test_agreement_refuses_other_labels(spark):
    rows = spark.createDataFrame([("c", [0.6, 0.4], [0.5, 0.5], 0, False)], "kind string, probs array<double>, distribution array<double>, y int, from_teacher boolean")
    priors = teacher.teacher_priors(rows.withColumn("from_teacher", F.lit(True)), ["kind"])
    with pytest.raises(PySparkException, match="teacher labels"):
        teacher.teacher_agreement(rows, priors, ["kind"], ["kind"]).collect()


def test_workflow_asks_by_earlier_decisions(spark):
    c = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "case_id int, t1 string, t2 string")
    steps = [("s1", F.lit(True), lambda d: d.select("case_id", F.col("t1").alias("decision"))), ("s2", F.col("s1") == "a", lambda d: d.select("case_id", F.lit("x").alias("decision")))]
    done = teacher.run_workflow(c, steps)
    assert {(r.case_id, r.s2, r.calls) for r in done.collect()} == {(1, "x", 2), (2, None, 1)}
    s = teacher.workflow_score(done.withColumn("all", F.lit(1)), {"s1": "t1", "s2": "t2"}, ["all"]).first()
    assert (s.n, s.judged, s.accuracy, s.mean_calls) == (2, 3, 1.0, 1.5)


def test_elements_own_the_texts_below_them():
    import random

    rng = random.Random(23)

    def grow(level):
        """(tag, attributes, children) with texts as leaves."""
        inner = [f"t{rng.randrange(99)}" if level > 3 or rng.random() < 0.5 else grow(level + 1) for _ in range(rng.randrange(0, 5))]
        return (rng.choice(["div", "p", "a", "span"]), {"role": "x"} if rng.random() < 0.3 else {}, [] if rng.random() < 0.1 else inner)

    def texts(node):
        for child in node[2]:
            yield from [child] if isinstance(child, str) else texts(child)

    def flat(node):
        yield node[0], node[1], list(texts(node))[: loaders.TEXTS]
        for child in node[2]:
            if not isinstance(child, str):
                yield from flat(child)

    def markup(node):
        return f"<{node[0]}{''.join(f' {k}={v}' for k, v in node[1].items())}>" + "<br>".join(c if isinstance(c, str) else markup(c) for c in node[2]) + f"</{node[0]}>"

    for _ in range(60):
        root = grow(0)
        got = [e for e in loaders.elements_of(markup(root)) if e[0] != "br"]
        assert got == list(flat(root))
    # an element left open ends with the one around it; a stray end tag ends nothing
    assert loaders.elements_of("<div><b>one</div></i>two") == [("div", {}, ["one"]), ("b", {}, ["one"])]
    assert loaders.elements_of("<p>one<img>two") == [("p", {}, ["one", "two"]), ("img", {}, [])]


def test_tasks_of_a_suite_share_their_draw(spark):
    from verdictlake.operators import compare, variants

    options = [f"option number {i}" for i in range(9)]
    cases = spark.createDataFrame([(c, 100 * k + i, options, i % 9) for k, c in enumerate("ab") for i in range(60)], "corpus string, case_id int, options array<string>, y int").repartition(4)
    tasks = [variants.Task("declared", "a"), variants.Task("shift", "a", 5), variants.Task("renamed", "a", 5, rename=True), variants.Task("held", "b", 5, shuffle=False), variants.Task("order", "a", 5, reorder=True)]
    got = {}
    for r in variants.build_tasks(cases, tasks, 20).collect():
        got.setdefault(r.task, {})[r.case_id] = r
    assert {t: len(rows) for t, rows in got.items()} == dict.fromkeys(["declared", "shift", "renamed", "held", "order"], 20)
    assert got["declared"].keys() == got["shift"].keys() == got["renamed"].keys() == got["order"].keys()
    for k, r in got["shift"].items():
        order, true = got["order"][k], options[got["declared"][k].y]
        assert r.options[r.y] == order.options[order.y] == true and sorted(r.options) == sorted(order.options) and len(r.options) == 5
        assert [o.lower().replace("_", " ").replace("-", " ") for o in got["renamed"][k].options] == r.options
    assert any(r.options != got["order"][k].options for k, r in got["shift"].items())
    assert all(r.options == sorted(r.options) and len(r.options) == 5 for r in got["held"].values())
    again = {(r.task, r.case_id): r.options for r in variants.build_tasks(cases.coalesce(1), tasks, 20).collect()}
    assert again == {(t, k): r.options for t, rows in got.items() for k, r in rows.items()}
    # answers that follow the name agree under both orders
    shown = variants.build_tasks(cases, tasks[1:2] + tasks[4:], 20).withColumn("probs", F.transform("options", lambda o: F.xxhash64(o) / F.lit(1e19)))
    both = compare.invariance(shown.where("task = 'shift'"), shown.where("task = 'order'"), ["case_id"], ["corpus"]).first()
    assert (both.n, both.agreement) == (20, 1.0)


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_word_spans_are_found_row_by_row_without_a_shuffle(spark):
    texts = ["", None, "  ", "é", " a b \U0001f600c\t\nd", "x\x0b\x0cy", "long " * 3000, "a", "b "]
    # one key: a row's words are its own, whatever other rows have its key
    frame = spark.createDataFrame([(7, t) for t in texts], "k int, t string").repartition(1)
    words = evidence.word_spans(frame, "t", ["k"])
    assert "Exchange" not in plan_of(evidence.word_spans(spark.range(3).selectExpr("id", "'a b' AS t"), "t", ["id"]))[1]
    want = []
    for t in texts:
        found = list(re.finditer(r"\S+", t or "", re.ASCII))
        for w, m in enumerate(found):
            until = found[w + 1].start() if w + 1 < len(found) else len(t)
            want.append((w, m.start(), m.end(), m.group(), t[m.end() : until], t[: m.start()] if w == 0 else ""))
    assert sorted(tuple(r)[1:] for r in words.collect()) == sorted(want)


def test_spans_merge_without_their_texts(spark):
    text = "ab  cd, ef \n gh"
    rows = [(1, 0, 2, 0.9), (1, 4, 6, 0.8), (1, 8, 10, 0.7), (1, 13, 15, 0.6), (1, 8, 9, 0.1)]
    told = spark.createDataFrame([(*r, text) for r in rows], "k int, start int, end int, score double, text string")
    ink = {0: 0, 4: 2, 8: 7, 13: 10}
    bare = spark.createDataFrame([(*r, ink[r[1]]) for r in rows], "k int, start int, end int, score double, ink int")
    want = [(0, 6, 0.9), (8, 15, 0.7)]
    assert sorted((r.start, r.end, r.score) for r in evidence.merge_spans(told, ["k"]).collect()) == want
    assert sorted((r.start, r.end, r.score) for r in evidence.merge_spans(bare, ["k"], ink="ink").collect()) == want


def test_probes_deal_words_by_case_once(spark):
    docs = spark.range(4).selectExpr("id", "concat(' a', id, ' b  c\td e ') AS text")
    words = evidence.word_spans(docs, "text", ["id"]).withColumn("score", F.col("w").cast("double"))
    probed = faithful.distinct_probes(faithful.probes(words, faithful.top_words(words, ["id"]), ["id"]), ["id"])
    assert probed.count() == 4 * 4
    # one for the ranks and one for words and choices together; no text is dealt again
    assert plan_of(probed)[1].count("Exchange hashpartitioning") == 2


def test_words_put_together_are_the_same_rows(spark):
    texts = ["b a  b", None, "", " \u00e9 a\tb \u00e9", "x " * 150_000, "a b\n"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1)
    rows = evidence.word_spans(frame, "t", ["k"], together=True).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, evidence.word_spans(frame, "t", ["k"]).collect()))
    # each word where it comes first, its rows in the order of the texts
    assert [r.word for r in rows] == ["b"] * 4 + ["a"] * 3 + ["\u00e9"] * 2 + ["x"] * 150_000
    assert [(r.k, r.w) for r in rows[:7]] == [(0, 0), (0, 2), (3, 2), (5, 1), (0, 1), (3, 1), (5, 0)]


def test_digests_of_words_take_little_space_when_written(spark, tmp_path):
    draw = random.Random(4)
    docs = [(k, " ".join(f"w{int(40_000 * draw.random() ** 3)}" for _ in range(1000))) for k in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    queries.QUERIES["e1_word_spans"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 400_000
    # a digest alone has 64 characters, and more words differ than a dictionary of Parquet holds
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 20 * 400_000
