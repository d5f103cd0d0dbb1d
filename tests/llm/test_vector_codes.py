"""Vector codes against plain Lloyd rounds over all pairs."""

import numpy as np
import pytest

from verdictlake.llm import vector_codes as V


def plain(rows, parts=4, k=256, rounds=4):
    """rows: (id, integers) in any order, to (codes, errors, codebooks)."""
    x = np.array([r[1] for r in rows], np.int64).reshape(len(rows), parts, -1)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, list(rows[i][1])))
    books = np.stack([x[order[:k], j] for j in range(parts)])

    def nearest():
        d = ((x[:, :, None] - books[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        near, _ = nearest()
        for j in range(parts):
            for e in range(books.shape[1]):
                if len(own := x[near[:, j] == e, j]):
                    books[j, e] = [sum(c) // len(own) for c in own.T.tolist()]
    near, d = nearest()
    return near, d.sum(1), books


@pytest.mark.parametrize("kind", ["even", "clusters", "ties", "far"])
def test_trees_assign_as_all_pairs_do(kind):
    rng = np.random.default_rng(3)
    for n, k, width in ((1500, 200, 5), (700, 64, 2), (37, 37, 3), (1, 1, 2)):
        x = {
            "even": lambda: rng.integers(-400, 400, (n, width)),
            "clusters": lambda: rng.integers(0, 6, (n, 1)) * 5000 + rng.integers(0, 5, (n, width)),
            "ties": lambda: rng.integers(-2, 2, (n, width)),
            "far": lambda: rng.integers(-(1 << 27), 1 << 27, (n, width)),
        }[kind]()
        book = x[rng.permutation(n)[:k]]
        if kind == "clusters":
            book = np.unique(x // 5000, axis=0)[:k] * 5000
        levels = V.depth(n, V.LEAF)
        tree = V.Tree(x, V.tree_order(x, levels), levels)
        found = V.assign(tree, V._entry_trees(book[None])[0])
        want = ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)
        got = np.empty(n, np.int64)
        got[tree.order] = found.entry
        assert (got == want).all()
        sums = np.zeros_like(book)
        np.add.at(sums, want, x)
        assert (sums == found.sums).all() and (np.bincount(want, minlength=len(book)) == found.counts).all()
        if kind == "clusters" and n == 1500:
            assert found.whole > n // 2  # cached sums assign whole nodes


def frame(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    return spark.createDataFrame(rows, schema)


def test_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(420, 8)), 2).astype(np.float32)
    vectors[40:60] = vectors[7]  # repeated rows
    rows = [(int(i), v.tolist(), None if i % 3 == 0 else int(i % 4)) for i, v in zip(rng.permutation(420), vectors)]
    rows += [(500, None, 1), (501, [None] + [0.0] * 7, 1), (502, [float("nan")] * 8, 1), (503, [float("inf")] + [0.0] * 7, None), (None, [0.25] * 8, 2), (3, [0.5] * 8, 2), (504, [], 1)]
    got, books = V.compress_vectors(frame(spark, rows).repartition(5), entries=40)
    kept = [r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all()]
    codes, errors, want = plain([(r[0], np.floor(np.array(r[1], np.float32).astype(float) * 1024).astype(int).tolist()) for r in kept], k=40)
    assert (books.entries == want).all() and books.text() == ",".join(str(c) for c in want.ravel())
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    expected = sorted((str(r[0]), bytes(c.tolist()), int(e), by_label[r[2]]) for r, c, e in zip(kept, codes, errors))
    assert sorted((str(r.vec_id), bytes(r.code), r.error, r.label_error) for r in got.collect()) == expected
    back = V.decode_vectors(got, books).where("vec_id = 3").first()
    assert len(back.decoded) == 8


def test_edges_of_vector_tables(spark):
    none, books = V.compress_vectors(frame(spark, []))
    assert none.count() == 0 and none.columns == ["vec_id", "label", "code", "error", "label_error"] and books.text() == ""
    only_bad, _ = V.compress_vectors(frame(spark, [(1, None, 1)]))
    assert only_bad.count() == 0
    few = frame(spark, [(1, [0.0] * 4, None), (1, [0.0] * 4, None), (2, [1.0] * 4, None)])
    got, books = V.compress_vectors(few.selectExpr("*", "repeat('x', 300000) AS note", "vec_id AS entry", "label AS part"))
    assert [(r.code.hex(), r.error, r.label_error, len(r.note)) for r in got.orderBy("vec_id").collect()] == [("00000000", 0, 0, 300000)] * 2 + [("02020202", 0, 0, 300000)]
    with pytest.raises(ValueError, match="already exist"):
        V.compress_vectors(few.withColumnRenamed("label", "code"), label="code")
    with pytest.raises(ValueError, match="one length"):
        V.compress_vectors(frame(spark, [(1, [0.0] * 4, 1), (2, [0.0] * 8, 1)]))
    with pytest.raises(Exception, match="too large"):
        V.compress_vectors(frame(spark, [(1, [3e38] * 4, 1)]))
