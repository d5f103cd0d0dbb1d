"""The pipeline and its near-dedup stage against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_corpus_operators import PATH, SCHEMA, brute_hits, brute_roots, passage
from verdictlake.llm import similar


def brute_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_unlike(rows):
    order = sorted(rows)
    roots = brute_roots([brute_set(t) for _, t in order], near)
    return {order[r][0] for r in roots}


def copies():
    rng = random.Random(11)
    rows, common = [], passage(77, 12)
    for g in range(12):
        words = passage(500 + g, rng.choice([6, 30, 64, 150])).split()
        rows.append(" ".join(words))
        for _ in range(rng.randint(1, 6)):
            other = list(words)
            for _ in range(rng.randint(1, 3)):
                other[rng.randrange(len(other))] = rng.choice(["new", "odd", "Word"])
            rows.append(" ".join(other[: len(other) - rng.randint(0, 3)]))
    rows += [f"{common} {passage(900 + i, 3)}" for i in range(20)] + ["", " \n", None, "one", "ONE", "one two", "a b c d e", "a b c d e f"]
    chain = passage(41, 80).split()
    rows += [" ".join(chain[i : i + 60]) for i in range(0, 20, 4)]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("frequent", [2, 10_000])
def test_similar_finds_every_pair(spark, monkeypatch, frequent):
    monkeypatch.setattr(similar, "FREQUENT", frequent)
    rows = copies()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    left = corpus_pipeline.keep_unlike(spark, docs, "")
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == brute_unlike(rows)


def test_one_changed_word_of_many(spark):
    words = passage(3, 64).split()
    rows = [(1, " ".join(words)), (2, " ".join([*words[:30], "changed", *words[31:]])), (3, passage(4, 64))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    assert near(brute_set(" ".join(words)), brute_set(" ".join([*words[:63], "changed"])))
    docs = docs.unionByName(spark.createDataFrame([(4, " ".join([*words[:63], "changed"]), "en", "s", 0)], SCHEMA))
    assert {r.doc_id for r in corpus_pipeline.keep_unlike(spark, docs, "").collect()} == {1, 3}


def test_prefix_of_alike_sets_meet():
    rng = random.Random(2)
    known = np.array(sorted(rng.sample(range(400), 50)), np.uint64)
    ranks = np.array([rng.randint(4, 9) for _ in known], np.int64)
    for _ in range(400):
        a = set(rng.sample(range(400), rng.randint(1, 60)))
        b = (a - set(rng.sample(sorted(a), len(a) // 9))) | set(rng.sample(range(400), len(a) // 9))
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        assert similar.alike(x, y) == near(a, b)
        if near(a, b):
            assert set(similar.prefix(x, known, ranks).tolist()) & set(similar.prefix(y, known, ranks).tolist())


def test_parity_bits_drop_no_alike_sets():
    rng = np.random.default_rng(5)
    for n in (1, 3, 9, 40, 300, 2000):
        for _ in range(30):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a[: n - rng.integers(0, n // 8 + 1)], rng.integers(0, 1 << 63, rng.integers(0, n // 8 + 1), dtype=np.uint64)])
            differ = int(np.bitwise_count((similar.parity_bits(a) ^ similar.parity_bits(b)).view(np.uint64)).sum())
            assert differ <= len(np.setxor1d(a, b))
            if similar.alike(np.sort(a), np.sort(b)):
                assert 9 * differ <= len(a) + len(b)


def test_pipeline_rows(spark, tmp_path):
    rows = copies()
    items = [(0, rows[3][1]), (1, passage(901, 3))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in [*rows, (900, rows[0][1]), (901, rows[20][1])]], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    by_text = {}
    for i, t in sorted((r.doc_id, r.text) for r in first.collect()):
        by_text[t or ""] = i
    texts = {i: t for t, i in by_text.items()}
    kept = {i for i in brute_unlike(list(texts.items())) if not brute_hits(texts[i], items)[1]}
    lib = Tokenizer.from_file(PATH)
    ids = {i: lib.encode(texts[i], add_special_tokens=False).ids for i in kept}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in ids.items()}
