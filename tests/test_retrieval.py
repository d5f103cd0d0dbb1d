"""Bounded shortlists and stored option sets against plain loops."""

import math
import random
from collections import Counter

import pytest

from verdictlake.functions.text import STOPWORDS, stem, stemmed, token_counts
from verdictlake.operators import retrieval as R


def words(rng, n):
    """Words of which the first are in most texts."""
    return " ".join(rng.choice(["common", "usual", "shared"]) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(n))


def plain_tokens(text):
    import re

    return [stemmed(w) for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) >= 2 and w not in STOPWORDS]


def plain_shortlist(queries, options, k):
    tf = {i: Counter(plain_tokens(t)) for i, t in options}
    df = Counter(t for c in tf.values() for t in c)
    n, average = len(options), sum(sum(c.values()) for c in tf.values()) / len(options)
    out = {}
    for q, text in queries:
        scores = {}
        for t in set(plain_tokens(text)):
            for i, c in tf.items():
                if t in c:
                    scores[i] = scores.get(i, 0.0) + math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average))
        best = sorted(((-round(s, 9), i) for i, s in scores.items()))[:k]
        chosen = [(i, -s) for s, i in best] + [(i, None) for i in sorted(i for i, _ in options) if i not in scores]
        out[q] = [(i, None if s is None else pytest.approx(s, abs=1e-6)) for i, s in chosen[:k]]
    return out


def tables(spark, seed, n_options=80, n_queries=40):
    rng = random.Random(seed)
    options = [(i, words(rng, rng.randrange(2, 12))) for i in range(n_options)]
    queries = [(q, words(rng, rng.randrange(1, 25))) for q in range(n_queries)] + [(900, "common usual"), (901, "zzz"), (902, ""), (903, None)]
    return options, queries, spark.createDataFrame(options, "idx long, text string").repartition(3), spark.createDataFrame(queries, "qid long, text string").repartition(2)


def ranked(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.qid, r.rank)):
        out.setdefault(r.qid, []).append((r.idx, r.score))
    return out


@pytest.mark.parametrize("frequent", [None, 3, 10, 1000])
def test_bounds_lose_no_option(spark, frequent):
    for seed in (1, 2):
        options, queries, o, q = tables(spark, seed)
        assert ranked(R.bm25_shortlist(q, o, 4, frequent).collect()) == plain_shortlist(queries, options, 4)


def test_some_queries_are_answered_from_rare_tokens(spark):
    options, _, o, q = tables(spark, 3, 300, 60)
    parts = R.weighted(*R.option_index(o))
    terms = token_counts(q, "text", ["qid"]).select("qid", "token").distinct()
    # options that rare tokens don't name and candidates that the bound drops never meet a frequent token
    met = terms.join(parts, "token").count()
    plan = R.best_options(terms, parts, 2, frequent=20)
    rare = terms.join(parts.where("df <= 20"), "token").count()
    assert rare < met and plan.count() == R.best_options(terms, parts, 2, frequent=10**9).count()


def test_a_store_indexes_a_set_once(spark, tmp_path):
    options, queries, o, q = tables(spark, 4)
    other, _, o2, _ = tables(spark, 5, 30)
    sets = o.selectExpr("'a' AS name", "*").unionByName(o2.selectExpr("'b' AS name", "*")).unionByName(o.selectExpr("'c' AS name", "*").repartition(5))
    store = R.OptionStore(spark, f"file://{tmp_path}/store")
    keys = {r.name: r.set_key for r in store.ensure(sets, "name").collect()}
    assert keys["a"] == keys["c"] != keys["b"]
    written = store.read("postings").count()
    assert written == sum(len(Counter(plain_tokens(t))) for _, t in [*options, *other])
    files = sorted(p.name for p in (tmp_path / "store" / "postings").iterdir())
    again = {r.name: r.set_key for r in store.ensure(sets, "name").collect()}
    assert again == keys and sorted(p.name for p in (tmp_path / "store" / "postings").iterdir()) == files
    changed = store.ensure(o.selectExpr("'d' AS name", "idx", "CASE WHEN idx = 0 THEN 'new' ELSE text END AS text"), "name").first().set_key
    assert changed not in keys.values() and store.read("postings").count() > written
    asked = q.crossJoin(spark.createDataFrame([(keys["a"],), (keys["b"],)], "set_key string"))
    rows = store.shortlist(asked, 3, frequent=5).collect()
    for name, known in (("a", options), ("b", other)):
        assert ranked([r for r in rows if r.set_key == keys[name]]) == plain_shortlist(queries, known, 3)
    plan = store.shortlist(asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan.split("LogicalRDD")[0] or str(tmp_path) not in plan.replace(f"{tmp_path}/store", "")


def test_stems_of_both_forms_agree(spark):
    rng = random.Random(6)
    some = ["".join(rng.choice("aeiouybdlnst") for _ in range(rng.randrange(1, 6))) + rng.choice(["", "ing", "ingly", "edly", "ies", "ied", "ed", "ly", "es", "s", "y", "e", "tt"]) for _ in range(400)]
    df = spark.createDataFrame([(w,) for w in some], "w string")
    assert {r.w: r.k for r in df.select("w", stem(df.w).alias("k")).collect()} == {w: stemmed(w) for w in some}
    counts = token_counts(spark.createDataFrame([(1, "Running jumped jumps, the RUN; a I x9 x9"), (2, None), (3, "")], "k int, text string"), "text", ["k"])
    assert {(r.k, r.token): r.n for r in counts.collect()} == {(1, "run"): 2, (1, "jump"): 2, (1, "x9"): 2}


def test_tokens_are_counted_in_parts_of_a_batch(spark):
    import pyarrow as pa

    from verdictlake.functions import text

    batch = pa.RecordBatch.from_pydict({"k": list(range(7)), "t": ["a" * 10, None, "b" * 100, "", "c", "d" * 30, "e"]})
    parts = list(text.text_parts(batch.slice(1), "t", 40))
    assert [p.column("k").to_pylist() for p in parts] == [[1], [2], [3, 4], [5], [6]]
    rows = [(i, None if i % 5 == 0 else f"running tests {i} " * (i % 40)) for i in range(400)]
    frame = spark.createDataFrame(rows, "k long, t string").repartition(1)
    want = sorted(tuple(r) for r in text.token_counts(frame, "t", ["k"]).collect())
    assert sum(n for _, token, n in want if token == "run") == sum(i % 40 for i in range(400) if i % 5)


def test_bag_shortlists_equal_the_shortlists_of_every_query(spark):
    draw = random.Random(4)
    words = [f"w{c}x" for c in "bcdfgh"]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 3))) for _ in range(150)]
    options = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    rows = [(f"q{i}", " ".join(draw.choices([*words, "unseen"], k=draw.randint(0, 3)))) for i in range(60)] + [("null", None)]
    queries = spark.createDataFrame(rows, "qid string, text string")
    got = {}
    for k in (2, 12):
        want = sorted(tuple(r) for r in R.bm25_shortlist(queries, options, k).collect())
        asked, best = R.bag_shortlists(queries, options, k)
        assert asked.select("asked").distinct().count() < 50
        got = asked.select("qid", "asked").join(best.withColumnRenamed("qid", "asked"), "asked").select("qid", "rank", "idx", "score")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_expanding_makes_the_map_once_a_row(spark):
    rows = spark.createDataFrame([(4, [2, 0], [0.7, 0.2])], "n int, idx array<int>, probs array<double>")
    out = R.expand_shortlist(rows)
    assert out.first().probs == [0.2, 0.0, 0.7, 0.0]
    # bound by an array of one, not named within the options' lambda
    assert "transform(array(map_from_arrays(" in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_store_lets_queries_meet_each_bag_once(spark, tmp_path):
    rng = random.Random(7)
    some = [words(rng, rng.randrange(1, 5)) for _ in range(25)]
    # copies, also in another order of words, and texts without tokens
    options = [(i, " ".join(rng.sample(t.split(), len(t.split()))) if t else t) for i, t in enumerate([*some, "", None] * 6)]
    queries = [(q, words(rng, rng.randrange(1, 8))) for q in range(30)] + [(900, "zzz"), (901, None), (902, some[0])]
    o, q = spark.createDataFrame(options, "idx long, text string").repartition(3), spark.createDataFrame(queries, "qid long, text string").repartition(3)
    store = R.OptionStore(spark, f"file://{tmp_path}/store")
    keys = store.ensure(o.selectExpr("'a' AS name", "*").unionByName(o.where("idx < 20").selectExpr("'b' AS name", "*")), "name")
    named = {r.name: r.set_key for r in keys.collect()}
    for name, known in (("a", options), ("b", options[:20])):
        bags = {frozenset(Counter(plain_tokens(t)).items()) for _, t in known}
        met = store.read("postings").where("stands").where(f"set_key = '{named[name]}'")
        assert met.count() == sum(map(len, bags)) < sum(len(set(plain_tokens(t))) for _, t in known)
        for k, frequent in ((2, 3), (9, 3), (9, None)):
            rows = [r for r in store.shortlist(q, k, frequent, keys).collect() if r.set_key == named[name]]
            assert ranked(rows) == plain_shortlist(queries, known, k)


def test_queries_of_rare_tokens_alone_are_ranked_once(spark):
    options, queries, o, q = tables(spark, 8, 120, 40)
    parts = R.weighted(*R.option_index(o))
    terms = token_counts(q, "text", ["qid"]).select("qid", "token").distinct()
    want = sorted(tuple(r) for r in R.best_options(terms, parts, 3, frequent=10**9).collect())
    for frequent in (2, 12, 40):
        got = R.best_options(terms, parts, 3, frequent=frequent)
        assert sorted(tuple(r) for r in got.collect()) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LeftSemi") >= 1
