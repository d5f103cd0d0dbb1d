"""Alignment of two tokenizers' ids by anchors at space-marked tokens.

A text is tokenised whole by a byte-level BPE vocabulary (A, of a space and the text) and by
a vocabulary of pieces (B, which adds the space itself). Both give the same bytes, so running
sums of token lengths place every token's end. Ends that both share before a token with a
leading space, in A as in B, are anchors; they cut a text into windows of a few ids of each
side. What a window aligns to depends on its ids alone and is remembered under the two tuples
of ids (found by a hash, then compared id by id), so a word is aligned once a worker. Within a window, byte offsets where tokens of both
sides end cut it into groups, and the two tokens that end there are linked.

How often an id pair is linked corpus-wide is summed within tasks, then by Spark. The counts
go back to the texts in blocks of at most ``PAIRS`` pairs, cut at ids of B, one broadcast of
checked size at a time; each block adds to ``n_best`` and ``count_sum``.

Edge cases: a null or empty text, and one whose tokens of either side don't join to a space
and the text, have no tokens and zeros throughout, with an empty ``groups``. Texts are
never cut; a very long one is a batch of its own. A worker forgets its windows when they are more
than ``REMEMBERED`` or have more than ``REMEMBERED_IDS`` ids. Special tokens written in a text are plain text. Repeated
rows count as often as they appear; an empty table gives an empty result. Other columns than
the text pass through, null or not, and a clash with an output column is an error before any job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Encoder, load_merges, same_words, utf8, word_hashes
from .common import drop_stage, require_free, slices, stage

SLICE_CHARS, PAIRS = 500_000, 2_000_000
REMEMBERED, REMEMBERED_IDS = 400_000, 4_000_000
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


class Sides:
    """Both tokenizers with the bytes, the length and the leading space of each of their ids."""

    def __init__(self, bpe_path: str, piece_path: str):
        merges = load_merges(bpe_path)
        self.a = Encoder({}, lambda cp, lens: merges.merge(*utf8(cp, lens)))
        self.decode_a = merges.decode
        self.size_a = np.diff(merges.piece_start)
        first = np.append(merges.piece_bytes, 0)[merges.piece_start[:-1]]
        self.space_a = (first == 0x20) & (self.size_a > 0)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.pieces = pieces
        self.size_b = np.array([len(p) for p in pieces])
        self.space_b = np.array([p[:1] == b" " for p in pieces])
        # ids in decimal, followed by what joins them within a group and by what ends their side of it
        self.named = [np.array([f"{i}{c}" for i in range(n)], object) for n, c in ((len(self.size_a), ","), (len(self.size_a), "|"), (len(pieces), ","), (len(pieces), ";"))]
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered: hashes in order, and by window its ids of both sides, its text and its links."""
        self.hashes, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids = [np.zeros(0, np.uint32), np.zeros(0, np.uint32)]
        self.at = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.texts: list[str] = []
        self.links, self.link_at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of A, ids before each text, and the same of B; nothing for a text that isn't whole in both."""
        flat_a, at_a = self.a.encode([" " + t if t else "" for t in texts])
        lists = self.b.encode(texts, num_threads=1)
        bytes_a = self.decode_a(flat_a)
        end_a = np.concatenate([[0], np.cumsum(self.size_a[flat_a])])[at_a].tolist()
        whole = np.zeros(len(texts), bool)
        for k, t in enumerate(texts):
            if t:
                raw = b" " + t.encode()
                whole[k] = bytes_a[end_a[k] : end_a[k + 1]] == raw and b"".join([self.pieces[i] for i in lists[k]]) == raw
        n_a = np.where(whole, np.diff(at_a), 0)
        if not whole.all():
            flat_a = flat_a[np.repeat(whole, np.diff(at_a))]
        lists = [x if w else [] for x, w in zip(lists, whole.tolist())]
        n_b = np.array([len(x) for x in lists], np.int64)
        flat_b = np.fromiter(chain.from_iterable(lists), np.int32, int(n_b.sum()))
        return flat_a.astype(np.int32), np.concatenate([[0], np.cumsum(n_a)]), flat_b, np.concatenate([[0], np.cumsum(n_b)])

    def _learn(self, a: np.ndarray, cut_a: np.ndarray, b: np.ndarray, cut_b: np.ndarray, windows: np.ndarray) -> int:
        """Align and remember the windows; the number of the first."""
        base = len(self.texts)
        if not len(windows):
            return base
        (a, at_a), (b, at_b) = _gather(a, cut_a, windows), _gather(b, cut_b, windows)
        _, i, j = np.intersect1d(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), assume_unique=True, return_indices=True)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[i] = last_b[j] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # ids in the order of the text: of each group those of A, then those of B
        words = np.empty(len(a) + len(b), object)
        words[np.arange(len(a)) + np.append(0, j + 1)[group_a]] = np.where(last_a, self.named[1][a], self.named[0][a])
        words[np.arange(len(b)) + (i + 1)[group_b]] = np.where(last_b, self.named[3][b], self.named[2][b])
        words, edges = words.tolist(), (at_a + at_b).tolist()
        self.texts += ["".join(words[x:y]) for x, y in zip(edges, edges[1:])]
        self.links = np.concatenate([self.links, b[j].astype(np.int64) << 32 | a[i]])
        self.link_at = np.concatenate([self.link_at, self.link_at[-1] + np.searchsorted(i, at_a[1:])])
        for k, (ids, at) in enumerate(((a, at_a), (b, at_b))):
            self.ids[k], self.at[k] = np.concatenate([self.ids[k], ids]), np.concatenate([self.at[k], self.at[k][-1] + at[1:]])
        return base

    def _numbers(self, a: np.ndarray, cut_a: np.ndarray, b: np.ndarray, cut_b: np.ndarray) -> np.ndarray:
        """The number of every window; windows meet by a hash and count as one if their ids of both sides are equal."""

        def same(mine: np.ndarray, ids: list[np.ndarray], at: list[np.ndarray], theirs: np.ndarray) -> np.ndarray:
            return same_words(a, cut_a, mine, ids[0], at[0], theirs) & same_words(b, cut_b, mine, ids[1], at[1], theirs)

        h = word_hashes(a, cut_a) * np.uint64(0x9E3779B97F4A7C15) + word_hashes(b, cut_b)
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, keys)
        known = np.append(self.hashes, np.uint64(0))[place] == keys
        known[place == len(self.hashes)] = False
        odd = np.zeros(len(keys), bool)
        old = np.flatnonzero(known)
        odd[old] = ~same(first[old], self.ids, self.at, self.slot[place[old]])
        odd = odd[which]
        again = np.flatnonzero(first[which] != np.arange(len(h)))
        odd[again] |= ~same(again, [a, b], [cut_a, cut_b], first[which[again]])
        new = np.flatnonzero(~known)
        base = self._learn(a, cut_a, b, cut_b, first[new])
        self.hashes = np.insert(self.hashes, place[new], keys[new])
        self.slot = np.insert(self.slot, place[new], base + np.arange(len(new)))
        slot = self.slot[np.searchsorted(self.hashes, keys)][which]
        strange = np.flatnonzero(odd)
        slot[strange] = self._learn(a, cut_a, b, cut_b, strange) + np.arange(len(strange))
        return slot

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A a text, ids of B a text, numbers of all windows, windows before each text and in all)."""
        if len(self.texts) > REMEMBERED or len(self.ids[0]) + len(self.ids[1]) > REMEMBERED_IDS:
            self.forget()
        a, at_a, b, at_b = self.encode(texts)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        before_a, before_b = np.append(self.space_a[a], True)[1:], np.append(self.space_b[b], True)[1:]
        before_a[at_a[1:][np.diff(at_a) > 0] - 1] = True
        before_b[at_b[1:][np.diff(at_b) > 0] - 1] = True
        anchors = np.intersect1d(end_a[before_a], end_b[before_b], assume_unique=True)
        cut_a, cut_b = np.append(0, np.searchsorted(end_a, anchors) + 1), np.append(0, np.searchsorted(end_b, anchors) + 1)
        edges = np.searchsorted(cut_a, at_a)
        if not len(anchors):
            return np.diff(at_a), np.diff(at_b), np.zeros(0, np.int64), edges
        return np.diff(at_a), np.diff(at_b), self._numbers(a.view(np.uint32), cut_a, b.view(np.uint32), cut_b), edges


def _gather(ids: np.ndarray, cut: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some windows one after the other, and where each begins, with the end."""
    size = cut[windows + 1] - cut[windows]
    out = np.cumsum(size)
    return ids[np.arange(out[-1]) + np.repeat(cut[windows] - out + size, size)], np.append(0, out)


@lru_cache(2)
def worker_sides(bpe_path: str, piece_path: str) -> Sides:
    """One pair of tokenizers in each Python worker."""
    return Sides(bpe_path, piece_path)


def link_rows(df: DataFrame, bpe_path: str, piece_path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """Rows without their text, with counts, ``groups`` and each linked id pair and its links as packed integers."""
    fields = [f for f in df.schema.fields if f.name != text]
    kind = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("groups", T.StringType()), T.StructField("_pairs", T.BinaryType()), T.StructField("_times", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = worker_sides(bpe_path, piece_path)
        for batch, texts in slices(batches, text, SLICE_CHARS):
            n_a, n_b, slot, edges = sides.align(texts)
            link_at, flat = sides.link_at, sides.links
            size = link_at[slot + 1] - link_at[slot]
            out = np.cumsum(size)
            found = flat[np.arange(out[-1]) + np.repeat(link_at[slot] - out + size, size)] if len(slot) else flat[:0]
            before = np.concatenate([[0], out])[edges]
            links = np.diff(before)
            # each text's id pairs in order, and how often it has them
            codes, rank = np.unique(found, return_inverse=True)
            each, n = np.unique(np.repeat(np.arange(len(texts)), links) << 40 | rank, return_counts=True)
            cuts = np.searchsorted(each >> 40, np.arange(len(texts) + 1)).tolist()
            packed, counted = codes[each & ((1 << 40) - 1)].astype("<i8"), n.astype("<i4")
            pairs, times = ([v[i:j].tobytes() for i, j in zip(cuts, cuts[1:])] for v in (packed, counted))
            named, groups = [sides.texts[k] for k in slot.tolist()], []
            for i, j in zip(edges.tolist(), edges[1:].tolist()):
                joined = "".join(named[i:j])[:-1]
                groups.append(hashlib.sha256(joined.encode()).hexdigest() if digest and joined else joined)
            others = [batch.column(f.name) for f in fields]
            columns = [pa.array(n_a), pa.array(n_b), pa.array(links), pa.array(links), pa.array(groups, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]
            yield pa.RecordBatch.from_arrays([*others, *columns], kind.fieldNames())

    return df.mapInArrow(run, kind)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(b, a, n): the links of each id pair; a task folds its rows before anything is shuffled."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(times)], ["b", "a", "n"])

        for batch in batches:
            new = [np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in (("_pairs", "<i8"), ("_times", "<i4"))]
            every, where = np.unique(np.concatenate([codes, new[0]]), return_inverse=True)
            times = np.bincount(where, np.concatenate([times, new[1]]), len(every)).astype(np.int64)
            codes = every
            if len(codes) > PAIRS:
                yield out()
                codes, times = codes[:0], times[:0]
        if len(codes):
            yield out()

    return rows.select("_pairs", "_times").mapInArrow(fold, "b int, a int, n long").groupBy("b", "a").agg(F.sum("n").alias("n"))


def blocks_of(counts: DataFrame) -> list[tuple[int, int]]:
    """Ranges of B ids that hold at most ``PAIRS`` pairs each, or the pairs of a single id."""
    by_b = sorted((r.b, r.pairs) for r in counts.groupBy("b").agg(F.count(F.lit(1)).alias("pairs")).collect())  # one row for each id of B's vocabulary
    out: list[tuple[int, int]] = []
    size = 0
    for b, n in by_b:
        if out and size + n <= PAIRS:
            out[-1], size = (out[-1][0], b), size + n
        else:
            out.append((b, b))
            size = n
    return out


def align_tokens(df: DataFrame, bpe_path: str, piece_path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """Rows with n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups`` in place of the text.

    ``groups``: ids of A and of B by group, as ``a1,a2|b1;a3|b2,b3``; with ``digest`` their SHA-256.
    ``n_best``: links whose pair has the highest count of its B id, ties included; ``count_sum``: counts summed over links."""
    require_free(df.drop(text), [*COUNTS, "groups", "n_best", "count_sum", "_pairs", "_times"])
    spark = df.sparkSession
    rows = stage(link_rows(df, bpe_path, piece_path, text, digest), "links").select("*", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    counts = stage(pair_counts(rows), "pair_counts")
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    marked = counts.join(best, "b").select(F.shiftleft(F.col("b").cast("long"), 32).bitwiseOR(F.col("a").cast("long")).alias("code"), "n", (F.col("n") == F.col("most")).alias("best"), "b")
    ranges = blocks_of(counts)
    for k, (low, high) in enumerate(ranges):
        block = marked.where(F.col("b").between(low, high)).drop("b").toArrow().sort_by("code")
        shared = spark.sparkContext.broadcast(tuple(block.column(c).to_numpy(zero_copy_only=False) for c in ("code", "n", "best")))
        rows = _look_up(rows, shared)
        if k < len(ranges) - 1:
            rows = stage(rows, "links")
    drop_stage(spark, counts)
    return rows.drop("_pairs", "_times")


def _look_up(rows: DataFrame, shared) -> DataFrame:
    """Add one block of counts to the sums of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = shared.value
        for batch in batches:
            pairs, times = (batch.column(c).to_pylist() for c in ("_pairs", "_times"))
            row = np.repeat(np.arange(len(pairs)), [len(p) // 8 for p in pairs])
            keys, each = np.frombuffer(b"".join(pairs), "<i8"), np.frombuffer(b"".join(times), "<i4")
            at = np.minimum(np.searchsorted(code, keys), len(code) - 1)
            hit = code[at] == keys
            at, each, row = at[hit], each[hit], row[hit]
            more = {"n_best": each * best[at], "count_sum": each * n[at]}
            columns = dict(zip(batch.schema.names, batch.columns))
            for c, v in more.items():
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, row, v)
                columns[c] = pa.array(total + columns[c].to_numpy())
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return rows.mapInArrow(run, rows.schema)
