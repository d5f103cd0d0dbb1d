"""Benchmark items without an id still hit."""

from verdictlake.llm import decontam


def test_items_without_an_id_hit(spark):
    bench = spark.createDataFrame([(None, "one two three"), (7, "four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three"), (2, "four five"), (3, "x")], "doc_id long, text string")
    for block_words in (1, 2_000_000):
        got = {r.doc_id: (r.hits, r["items"]) for r in decontam.find_hits(docs, bench, block_words=block_words).collect()}
        assert got == {1: ([1, 2, 3], []), 2: ([0, 1], ["7"]), 3: ([], [])}
    assert [r.doc_id for r in decontam.remove_contaminated(docs, bench).collect()] == [3]
