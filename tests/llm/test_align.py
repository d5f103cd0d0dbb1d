"""Token alignment against the two libraries and plain loops."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from verdictlake.llm import align

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
OUT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def plain(texts):
    """The seven columns of each text, from whole tokenisations and every shared end."""
    a_side, b_side = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_side.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    a_bytes = {i: bytes(byte[c] for c in t) for t, i in a_side.get_vocab().items() if all(c in byte for c in t)}

    def b_bytes(i):
        piece = b_side.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()

    rows = []
    for t in texts:
        a = a_side.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_side.encode(t) if t else []
        raw = (" " + (t or "")).encode()
        if b"".join(a_bytes.get(i, b"") for i in a) != raw or b"".join(map(b_bytes, b)) != raw:
            a = b = []
        ends = []
        for ids, size in ((a, lambda i: len(a_bytes[i])), (b, lambda i: len(b_bytes(i)))):
            at, place = 0, {}
            for k, i in enumerate(ids):
                at += size(i)
                place[at] = k
            ends.append(place)
        groups, links, x, y = [], [], 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            i, j = ends[0][e], ends[1][e]
            groups.append(",".join(map(str, a[x : i + 1])) + "|" + ",".join(map(str, b[y : j + 1])))
            links.append((a[i], b[j]))
            x, y = i + 1, j + 1
        rows.append((len(a), len(b), ";".join(groups), links))
    times = Counter(p for r in rows for p in r[3])
    most = {}
    for (_, b), n in times.items():
        most[b] = max(most.get(b, 0), n)
    return [(a, b, len(links), len(links), sum(times[p] == most[p[1]] for p in links), sum(times[p] for p in links), g) for a, b, g, links in rows]


def odd_texts():
    rng = random.Random(4)
    words = ["the", " ", "  ", "\n", "\t", "Ärger", "naïve", "12345", "<|endoftext|>", "<s>", "</s>", "<0x41>", "日本語", "🙂", "'ll", "don't", "aaaaaaaaaaaa", "_x_", "…", "-", "é", " ", "http://a.b/c?d=1"]
    made = ["".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    return [None, "", " ", "   x", "▁ marks", "a\u0000b", "tail ", *made, *made[:5], "word " * 30000, "x" * 20000, "語" * 3000]


@pytest.mark.parametrize("pairs", [align.PAIRS, 40])
def test_alignment_equals_plain_loops(spark, monkeypatch, pairs):
    monkeypatch.setattr(align, "PAIRS", pairs)  # small blocks: counts come back one broadcast after the other
    texts = odd_texts()
    df = spark.createDataFrame([(k, t, None, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string, a string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in OUT) for r in align.align_tokens(df, BPE, PIECES).collect()}
    for k, want in enumerate(plain(texts)):
        assert got[k] == want, texts[k] and texts[k][:80]
    digests = {r.doc_id: r.groups for r in align.align_tokens(df, BPE, PIECES, digest=True).collect()}
    assert all(digests[k] == (hashlib.sha256(got[k][-1].encode()).hexdigest() if got[k][0] else "") for k in got)


def test_edges_of_alignment(spark, monkeypatch):
    none = align.align_tokens(spark.createDataFrame([], "doc_id long, text string"), BPE, PIECES)
    assert none.count() == 0 and none.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    nulls = align.align_tokens(spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string"), BPE, PIECES).collect()
    assert [tuple(r[c] for c in OUT) for r in nulls] == [(0, 0, 0, 0, 0, 0, "")] * 2
    with pytest.raises(ValueError, match="already exist"):
        align.align_tokens(spark.createDataFrame([(1, "x")], "N_A long, text string"), BPE, PIECES)
    # what a worker remembers is bounded and changes nothing
    sides = align.Sides(BPE, PIECES)
    monkeypatch.setattr(align, "REMEMBERED", 2)
    texts = ["some words here", "other words there", "some words here"]
    first = [sides.align([t])[0].tolist() for t in texts]
    assert first[0] == first[2] and len(sides.texts) <= 6
