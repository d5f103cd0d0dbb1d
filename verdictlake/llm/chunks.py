"""Substring deduplication by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes run through a gear hash of the last 16 bytes. After a white-space
byte, a chunk ends where the top bits of the hash are zero and the chunk has at least
``MIN_BYTES``; without such a place it ends at the first white space from ``MAX_BYTES``
on. Where white space is further apart than that, as in scripts written without it, a
chunk may end before any character that the hash chooses more rarely, and at ``HARD_BYTES``
at last. Boundaries depend on nearby content alone, so an insertion shifts the chunks
behind it and changes no more than one or two of them.

Texts are chunked once, into a table in the shared folder. Chunks meet by a 64-bit digest
of their words and by their number of words. The first occurrence, by id (none first),
row and place, stays; a maximal run of other occurrences of at least ``min_words`` words is
a repeated span, be it in another document or further on in the same one. A passage loses
up to a chunk at either end to its surroundings, so the default of 24 words stands for
passages of about 50; a stock phrase or a common line stays below it. In scripts without
white space four wide characters count as a word.

Chunks form runs of about four, which end where a chunk's digest says so, so that copies of a
passage have the same runs. Of the runs that a Misra-Gries summary finds frequent only the
first occurrence goes on as chunks: another one holds no chunk that is the first of its kind,
so it is one place that repeats as a whole, whose first id is the smallest of its chunks.
Digests of chunks that are frequent in what is left are counted with partial sums and joined
by broadcast; of both kinds there are at most ``exact.TRACKED``. All others meet by a shuffle.
No group is gathered in one task but the chunks of one document.

Edge cases: null and empty texts have no chunks; every row is a document of its own, also
rows without an id, rows that share one and copies of a row (of which the first stays); a
very long text is chunked whole, in a slice of its own; an
empty table gives an empty result; other columns are ignored by the report and pass through
``remove_repeats`` under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage
from .exact import frequent

WINDOW, MIN_BYTES, MAX_BYTES, HARD_BYTES = 16, 16, 192, 1024
TOP_BITS, RARE_BITS = 2, 5
RUN_BITS, MAX_RUN = 2, 32
MIN_WORDS, WIDE_CHARS = 24, 4
NO_ID = -(1 << 63)
CHUNKS = "id long, row long, n int, words int, begin int, finish int, digest long, run long, at int, run_size int, run_words int, run_finish int"

_GEAR = np.random.default_rng(2016).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(values: np.ndarray) -> np.ndarray:
    """Sum over the last WINDOW bytes of gear value shifted by age, in 32 bits, by doubling."""
    h, width = values.copy(), 1
    while width < WINDOW:
        older = np.zeros_like(h)
        older[width:] = h[:-width] << np.uint32(width)
        h += older
        width *= 2
    return h


def cut_points(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text's bytes."""
    if not len(data):
        return []
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    h = gear_hashes(_GEAR[data])
    # the window's oldest bytes reach the top bits, so the choice looks at all of it
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    at = np.flatnonzero(space) + 1
    chosen = (h[at - 1] >> np.uint32(32 - TOP_BITS)) == 0
    ends = np.concatenate([[0], at, [len(data)]])
    wide = np.flatnonzero(np.diff(ends) > MAX_BYTES)
    if len(wide):
        # no white space for long: characters may start a chunk wherever the hash says so
        rare = np.flatnonzero((h[:-1] >> np.uint32(32 - RARE_BITS) == 0) & ((data[1:] & 0xC0) != 0x80)) + 1
        k = np.searchsorted(ends, rare) - 1
        rare = rare[np.isin(k, wide) & (rare < ends[k + 1])]
        at, chosen = np.concatenate([at, rare]), np.concatenate([chosen, np.ones(len(rare), bool)])
        order = np.argsort(at, kind="stable")
        at, chosen = at[order], chosen[order]
    out, last, n = [], 0, len(data)
    for p, ok in zip(at.tolist(), chosen.tolist()):
        while p - last > HARD_BYTES:
            last = _char_start(data, last + HARD_BYTES)
            out.append(last)
        size = p - last
        if (ok and size >= MIN_BYTES) or size >= MAX_BYTES:
            out.append(p)
            last = p
    while n - last > HARD_BYTES:
        last = _char_start(data, last + HARD_BYTES)
        out.append(last)
    if last < n:
        out.append(n)
    return out


def _char_start(data: np.ndarray, p: int) -> int:
    while p < len(data) and data[p] & 0xC0 == 0x80:
        p += 1
    return p


def run_starts(digests: np.ndarray) -> np.ndarray:
    """Where the runs of one text's chunks start: behind a chunk whose digest ends in zero bits, and MAX_RUN chunks on at last."""
    starts = np.flatnonzero(np.concatenate([[True], digests[:-1] & np.uint64((1 << RUN_BITS) - 1) == 0]))
    sizes = np.diff(np.append(starts, len(digests)))
    if sizes.max() > MAX_RUN:
        starts = np.concatenate([np.arange(a, a + n, MAX_RUN) for a, n in zip(starts.tolist(), sizes.tolist())])
    return starts


def chunk_rows(df: DataFrame, id_col: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row for each chunk: id, row, its number, words, code points from begin to finish, digest; of its run the digest,
    the chunk's place in it and, in the run's first chunk alone, the number of its chunks and words and its finish.

    ``row`` names a column of distinct numbers; without it rows are numbered here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 500_000):
            index, number, words, begin, finish, digests = [], [], [], [], [], []
            run_digests, sizes = [], []
            for k, t in enumerate(texts):
                raw = t.encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, np.uint8)
                ends = cut_points(data)
                chars, wide = ends, None
                if len(raw) != len(t) and ends:
                    chars = np.cumsum((data & 0xC0) != 0x80)[np.array(ends, np.int64) - 1].tolist()
                    wide = np.diff(np.concatenate([[0], np.cumsum(data >= 0xE0)[np.array(ends, np.int64) - 1]])) // WIDE_CHARS
                index += [k] * len(ends)
                number += range(len(ends))
                begin += [0, *chars[:-1]] if ends else []
                finish += chars
                h = xxhash.xxh3_64_intdigest
                pieces = [raw[a:b].split() for a, b in zip([0, *ends], ends)]
                words += map(len, pieces) if wide is None else np.maximum(wide, [len(p) for p in pieces]).tolist()
                if ends:
                    own = np.array([h(b" ".join(p)) for p in pieces], np.uint64)
                    digests.append(own)
                    bounds = np.append(run_starts(own), len(own))
                    sizes.append(np.diff(bounds))
                    packed, at = own.tobytes(), (8 * bounds).tolist()
                    run_digests += [h(packed[a:b]) for a, b in zip(at, at[1:])]
            which = pa.array(index, pa.int64())
            size = np.concatenate([np.zeros(0, np.int64), *sizes])
            heads = np.cumsum(size) - size
            later = np.ones(len(index), bool)
            later[heads] = False
            run = np.repeat(np.array(run_digests, np.uint64), size).view(np.int64)
            at = np.arange(len(index)) - np.repeat(heads, size)
            total = np.add.reduceat(np.array(words, np.int64), heads) if len(heads) else size

            def of_heads(values: np.ndarray) -> pa.Array:
                return pa.array(np.repeat(values, size), pa.int32(), mask=later)

            last = np.array(finish, np.int64)[heads + size - 1]
            columns = [batch.column("id").take(which), batch.column("row").take(which), *(pa.array(x, pa.int32()) for x in (number, words, begin, finish)), pa.array(np.concatenate([np.zeros(0, np.uint64), *digests]).view(np.int64))]
            columns += [pa.array(run), pa.array(at, pa.int32()), *map(of_heads, (size, total, last))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CHUNKS.split(", ")])

    return df.select(F.col(id_col).cast("long").alias("id"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(text).alias("text")).mapInArrow(run, CHUNKS)


def _repeats(chunks: DataFrame) -> DataFrame:
    """Chunks that aren't the first of their kind, with the id of the first."""
    key = ["digest", "words"]
    first = [F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "row", "n")).alias("first")]
    heavy = chunks.select("id", "row", "n", *key).join(F.broadcast(frequent(chunks, "digest")), "digest", "left_semi").groupBy(*key).agg(*first).select(*key, F.col("first").alias("known"))
    marked = chunks.join(F.broadcast(heavy), key, "left")
    settled = marked.where(F.col("known").isNotNull()).withColumnRenamed("known", "first")
    others = marked.where(F.col("known").isNull()).drop("known")
    seen = others.groupBy(*key).agg(*first).where("times > 1").drop("times")
    every = settled.unionByName(others.join(seen, key), allowMissingColumns=False)
    return every.where(~((F.col("row") == F.col("first.row")) & (F.col("n") == F.col("first.n"))))


def _frequent_runs(chunks: DataFrame) -> DataFrame:
    """(run, top_row, top_n, low) of frequent runs: row and number of the first occurrence, and the smallest first id of its chunks.

    A staged table of at most ``exact.TRACKED`` rows, so that all who read it see the same runs."""
    key = ["digest", "words"]
    heads = chunks.where("at = 0").select("id", "row", "n", "run")
    top = heads.join(F.broadcast(frequent(heads, "run")), "run", "left_semi").groupBy("run").agg(F.min(F.struct("id", "row", "n")).alias("top"), F.count(F.lit(1)).alias("times")).where("times > 1")
    top = stage(top.select("run", F.col("top.row").alias("top_row"), F.col("top.n").alias("top_n")), "runs")
    own = chunks.join(F.broadcast(top), "run").where((F.col("row") == F.col("top_row")) & (F.col("n") - F.col("at") == F.col("top_n"))).select("run", "top_row", "top_n", *key)
    own = stage(own, "runs")
    first = chunks.join(F.broadcast(own.select(*key).distinct()), key, "left_semi").groupBy(*key).agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("low"))
    return stage(own.join(first, key).groupBy("run", "top_row", "top_n").agg(F.min("low").alias("low")), "runs")


def _places(chunks: DataFrame) -> DataFrame:
    """What repeats, chunk by chunk or, of frequent runs, run by run: id, row, number, words, begin, finish, first id, chunks."""
    known = F.broadcast(_frequent_runs(chunks).withColumnRenamed("run", "same"))
    again = (F.col("run") == F.col("same")) & ~((F.col("row") == F.col("top_row")) & (F.col("n") - F.col("at") == F.col("top_n")))
    whole = chunks.where("at = 0").join(known, again).select("id", "row", "n", F.col("run_words").alias("words"), "begin", F.col("run_finish").alias("finish"), F.col("low").alias("first"), F.col("run_size").alias("size"))
    single = _repeats(chunks.join(known, again, "left_anti"))
    return single.select("id", "row", "n", "words", "begin", "finish", F.coalesce(F.col("first.id"), F.lit(NO_ID)).alias("first"), F.lit(1).alias("size")).unionByName(whole)


def row_spans(chunks: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, id, spans) of the rows of a chunk table that have a repeated span."""
    places = _places(chunks).groupBy("row").agg(F.first("id").alias("id"), F.collect_list(F.struct("n", "words", "begin", "finish", "first", "size")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("finish", pa.int32()), ("first_id", pa.int64())]))
        for batch in batches:
            keep, out = [], []
            for k, rows in enumerate(batch.column("places").to_pylist()):
                if spans := runs(sorted(tuple(r.values()) for r in rows), min_words):
                    keep.append(k)
                    out.append(spans)
            which = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(which), batch.column("id").take(which), pa.array(out, kind)], ["row", "id", "spans"])

    return places.mapInArrow(run, "row long, id long, spans array<struct<begin:int,finish:int,first_id:long>>")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of ``df`` with a repeated span: id, n_spans, repeated_chars, spans, first_ids.

    spans: array of (begin, finish, first_id) in code points; first_id is the smallest id
    among the first occurrences of the span's chunks. first_ids: their distinct values."""
    found = row_spans(stage(chunk_rows(df, id_col, text), "chunks"), min_words)
    width = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["finish"] - s["begin"])
    return found.select(F.col("id").alias(id_col), F.size("spans").cast("long").alias("n_spans"), width.alias("repeated_chars"), "spans", F.array_sort(F.array_distinct(F.col("spans.first_id"))).alias("first_ids"))


def runs(rows: list[tuple[int, int, int, int, int, int]], min_words: int) -> list[dict]:
    """Maximal runs of neighbouring places (number, words, begin, finish, first id, chunks) of at least ``min_words`` words."""
    starts = [k for k, r in enumerate(rows) if k == 0 or r[0] > rows[k - 1][0] + rows[k - 1][5]]
    out = []
    for a, b in zip(starts, [*starts[1:], len(rows)]):
        if sum(r[1] for r in rows[a:b]) >= min_words:
            first = min(r[4] for r in rows[a:b])
            out.append({"begin": rows[a][2], "finish": rows[b - 1][3], "first_id": first if first != NO_ID else None})
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with the repeated spans cut out of its texts."""
    numbered = stage(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
    chunks = stage(chunk_rows(numbered.select("number", F.col("row")[id_col].alias("id"), F.col("row")[text].alias("text")), "id", "text", "number"), "chunks")
    spans = row_spans(chunks, min_words).select(F.col("row").alias("number"), "spans")

    @F.pandas_udf("string")
    def cut(texts, found):
        def one(t, s):
            if t is None or s is None or not len(s):
                return t
            ends = [0, *(x["finish"] for x in s)]
            return "".join(t[a:b] for a, b in zip(ends, [*(x["begin"] for x in s), len(t)]))

        return type(texts)([one(t, s) for t, s in zip(texts, found)])

    left = F.when(F.col("spans").isNull(), F.col("row")[text]).otherwise(cut(F.col("row")[text], F.col("spans")))
    joined = numbered.join(spans, "number", "left")
    return joined.select(*[left.alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns])
