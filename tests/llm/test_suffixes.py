"""Removal of repeated bytes against a set of all strings of 100 bytes."""

import random

import numpy as np
import pytest

from verdictlake.llm import suffixes as S


def plain(rows):
    """rows (id, number, text) to {number: (spans, kept)}: every string of 100 bytes looked up among those before it."""
    seen, out = set(), {}
    for _, number, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        out[number] = (list(zip(edges[::2].tolist(), edges[1::2].tolist())), bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


def test_flags_of_one_shard():
    rng = random.Random(6)
    for _ in range(60):
        base = bytes(rng.choice(b"ab\x00\xffz") for _ in range(rng.randrange(150, 400)))
        bodies = []
        for _ in range(rng.randrange(1, 40)):
            i, n = rng.randrange(0, len(base) - 120), rng.randrange(1, 70)
            b = bytearray(b"a" * (n + 99) if rng.random() < 0.1 else base[i : i + n + 99])
            if rng.random() < 0.5:
                b[rng.randrange(len(b))] = rng.choice(b"abq\x00")
            if len(b) >= 100:
                bodies.append(bytes(b))
        seen, want = set(), []
        for b in bodies:
            for j in range(len(b) - 99):
                want.append(b[j : j + 100] in seen)
                seen.add(b[j : j + 100])
        if bodies:
            assert S.later_strings(bodies, np.array([len(b) - 99 for b in bodies])).tolist() == want


def test_common_prefixes_stop_at_the_threshold():
    rng = np.random.default_rng(8)
    for stop in (1, 2, 5, 20):
        text = np.append(rng.integers(1, 3, 400), 0).astype(np.uint8)
        order = S.sorted_suffixes(text)
        short = S.short_prefixes(text, order, stop)
        raw = bytes(text)
        for k in range(1, len(raw)):
            a, b = raw[order[k - 1] :][:stop], raw[order[k] :][:stop]
            assert short[k] == (a != b or len(a) < stop)


def test_minimizers_depend_on_the_string_alone():
    rng = np.random.default_rng(9)
    text = rng.integers(97, 100, 3000).astype(np.uint8)
    text[500:900] = text[1500:1900]
    text[2000:2400] = 97  # ties everywhere
    name, gram, start, count, lead = S.minimizers(text, np.array([1200, 0, 50, 1750]))
    of = {(t, s + j): (g, m - j) for t, g, s, n, m in zip(name.tolist(), gram.tolist(), start.tolist(), count.tolist(), lead.tolist()) for j in range(n)}
    assert len(of) == 1101 + 1651
    same = {}
    for (t, s), found in of.items():
        at = s if t == 0 else 1250 + s
        assert same.setdefault(text[at : at + 100].tobytes(), found) == found and 0 <= found[1] < S.REACH


def passages(rng):
    words = ["ant", "bee", "cow", "dove", "eel", "fox", "gnu", "hen", "Ärger", "日本", "🙂"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    shared = [say(30) for _ in range(4)]
    line = say(12)[:70]
    rows = []
    for k in range(60):
        parts = [say(rng.randrange(3, 40))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice([rng.choice(shared), line, shared[0][: rng.randrange(90, 160)]]), say(rng.randrange(1, 25))]
        rows.append(" ".join(parts))
    near = list(rows[3] * 3)
    near[200] = "#"
    return [*rows, rows[5], rows[5] + "!", "".join(near), "a" * 900, "ab" * 300, line * 40, "", None, "x" * 99, "y" * 100, "y" * 100]


@pytest.mark.parametrize("crowd", [S.CROWD, 2])
def test_removal_equals_looking_up_every_string(spark, monkeypatch, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)  # two contexts a minimizer already crowd a shard: strings are dealt anew, down to single ones
    monkeypatch.setattr(S, "SHARD_BYTES", 3000)
    texts = passages(random.Random(10))
    ids = [None if k % 17 == 0 else 7 if k % 13 == 0 else (k * 37) % 101 for k in range(len(texts))]
    rows = [(i, k, t, "x") for k, (i, t) in enumerate(zip(ids, texts))]
    df = spark.createDataFrame(rows, "doc_id long, number long, text string, gram string").repartition(1).sortWithinPartitions("number")
    got = {r.number: ([(s.begin, s.finish) for s in r.spans], bytes(r.kept), r.n_bytes, r.n_removed) for r in S.remove_repeated_bytes(df).collect()}
    want = plain([r[:3] for r in rows])
    assert len(got) == len(rows) and sum(len(s) for s, _ in want.values()) > 20
    for k, (spans, kept) in want.items():
        assert got[k] == (spans, kept, len((texts[k] or "").encode()), sum(b - a for a, b in spans)), k


def test_edges_of_removal(spark):
    none = S.remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string, first string"))
    assert none.count() == 0 and none.columns == ["doc_id", "first", "n_bytes", "n_removed", "spans", "kept"]
    with pytest.raises(ValueError, match="already exist"):
        S.remove_repeated_bytes(spark.createDataFrame([(1, "x", 1)], "doc_id long, text string, Kept long"))
    rng = random.Random(11)
    huge = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    rows = S.remove_repeated_bytes(spark.createDataFrame([(1, huge), (2, "tail " + huge[-300:])], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed) for r in rows] == [(1_500_000, 0), (305, 300)] and bytes(rows[1].kept) == b"tail "
