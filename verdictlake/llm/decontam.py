"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Item texts become word windows: ten consecutive words, or all words of a shorter item.
Windows are kept as rolling hashes over small word numbers; only words that occur in
some item have a number, so a text is mapped once and most of it falls out at once.
Every hash hit is verified against the window's words before it counts.

The windows are broadcast in blocks of at most ``block_words`` item words. Longer items
are cut into pieces that overlap by a window less one word, and a benchmark larger than one
block is dealt into blocks of checked size. Each block is scanned, its hits are written,
and its broadcast is destroyed before the next one is built, so what the driver and the
executors hold at once doesn't grow with the benchmark, and no item is left out.

Edge cases: null or wordless texts and items have no words and no windows; items with
the same words hit together; a very long text is scanned whole; items without an id hit like others and are not listed;
repeated rows, null ids and other columns pass through, a clash with ``n_words``, ``hits``
or ``items`` is an error; empty tables give no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stage, require_free, shared_path, slices, stage

# fixed value: what separates words
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
WINDOW = 10
BLOCK_WORDS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


class Windows:
    """The windows of some items: word numbers, sorted hashes and the items behind each window."""

    def __init__(self, items: list[tuple[object, str | None]], width: int = WINDOW):
        self.number: dict[str, int] = {}
        at: dict[tuple[int, ...], set[int]] = {}
        self.items = [None if i is None else str(i) for i, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
            for s in range(max(1, len(ids) - width + 1) if ids else 0):
                at.setdefault(tuple(ids[s : s + width]), set()).add(k)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, list[list[int]]]] = {}
        for n in sorted({len(w) for w in at}):
            grams = np.array([w for w in at if len(w) == n], np.int64)
            h = self.hashes(grams.reshape(-1), n)[::n]
            order = np.argsort(h, kind="stable")
            owners = [sorted(x) for w, x in at.items() if len(w) == n]
            self.by_length[n] = h[order], grams[order], [owners[i] for i in order]

    @staticmethod
    def hashes(ids: np.ndarray, n: int) -> np.ndarray:
        """Hash of the ``n`` numbers from each place on."""
        v = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(29)
        out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        for k in range(n):
            out *= _BASE
            out += v[k : k + len(out)]
        return out

    def scan(self, texts: list[str]) -> tuple[list[int], list[np.ndarray], list[list[str]]]:
        """For each text: number of words, positions of hit words, items with a window in it."""
        counts, parts = [], []
        get = self.number.get
        for t in texts:
            words = words_of(t)
            counts.append(len(words))
            parts.append(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))
            parts.append(np.array([-1]))  # no window crosses texts
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        begin = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
        cover = np.zeros(len(ids) + 1, np.int64)
        found: list[set[str]] = [set() for _ in texts]
        strange = np.concatenate([[0], np.cumsum(ids < 0)])
        for n, (known, grams, owners) in self.by_length.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(strange[n:] == strange[:-n])
            if not len(at):
                continue
            h = self.hashes(ids, n)[at]
            low, high = np.searchsorted(known, h), np.searchsorted(known, h, "right")
            for p, a, b in zip(at[low < high], low[low < high], high[low < high]):
                for w in range(a, b):
                    if (grams[w] == ids[p : p + n]).all():
                        cover[p] += 1
                        cover[p + n] -= 1
                        found[int(np.searchsorted(begin, p, "right")) - 1].update(self.items[k] for k in owners[w] if self.items[k] is not None)
        hit = np.cumsum(cover[:-1]) > 0
        return counts, [np.flatnonzero(hit[a : b - 1]) for a, b in zip(begin, begin[1:])], [sorted(x) for x in found]


def item_pieces(items: DataFrame, width: int, piece_words: int) -> DataFrame:
    """items (id, t) to (id, t, size): words of an item joined by a space, in pieces of at most ``piece_words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist()):
                words, step = words_of(t), max(1, piece_words - width + 1)
                cuts = range(0, max(1, len(words) - width + 1), step) if words else []
                parts = [words[c : c + step + width - 1] for c in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(parts), pa.string()), pa.array([" ".join(p) for p in parts], pa.string()), pa.array([len(p) for p in parts], pa.int64())], ["id", "t", "size"])

    return items.mapInArrow(run, "id string, t string, size long")


def find_hits(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add n_words, hits (positions of hit words) and items (ids as sorted text) to every row of ``df``."""
    require_free(df, ["n_words", "hits", "items"])
    spark = df.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("t"))
    # an upper bound of the words: every second byte could be one
    if (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) <= 2 * block_words:
        return _scan(df, [tuple(r) for r in items.collect()], text, width)[0]
    pieces = stage(item_pieces(items, width, max(width, block_words // 4)).distinct(), "pieces")
    total, longest = pieces.agg(F.sum("size"), F.max("size")).first()
    blocks = int(2 * (total or 0) // block_words) + 1
    while True:
        own = F.pmod(F.xxhash64("id", "t"), F.lit(blocks))
        # a row for each block
        sizes = {r[0]: r[1] for r in pieces.groupBy(own).agg(F.sum("size")).collect()}
        if max(sizes.values(), default=0) <= max(block_words, longest or 0):
            break
        blocks *= 2
    # rows are numbered once, in a table that all blocks read
    numbered = stage(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("number")), "numbered")
    words = _scan(numbered.select("number", "text"), [], "text", width)[0].select("number", "n_words")
    found = shared_path(spark, "hits")
    spark.createDataFrame([], "number long, hits array<int>, items array<string>").write.mode("append").parquet(found)
    for b in sorted(sizes):
        hit, shared = _scan(numbered.select("number", "text"), [(r["id"], r["t"]) for r in pieces.where(own == b).select("id", "t").collect()], "text", width)
        hit.where(F.size("hits") > 0).select("number", "hits", "items").write.mode("append").parquet(found)
        shared.destroy()
    drop_stage(spark, pieces)
    every = spark.read.schema("number long, hits array<int>, items array<string>").parquet(found)
    merged = every.groupBy("number").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items")])
    lists = [F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c) for c, t in (("hits", "int"), ("items", "string"))]
    return numbered.join(words, "number").join(merged, "number", "left").select("row.*", "n_words", *lists)


def _scan(df: DataFrame, items: list[tuple[str, str | None]], text: str, width: int) -> tuple[DataFrame, Broadcast]:
    shared = df.sparkSession.sparkContext.broadcast(Windows(items, width))
    schema = T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch, texts in slices(batches, text, 2_000_000):
            counts, hits, found = windows.scan(texts)
            more = [pa.array(counts, pa.int64()), pa.array([h.astype(np.int32) for h in hits], pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    return df.mapInArrow(run, schema), shared


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def remove_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", how: str = "document") -> DataFrame:
    """The rows of ``df`` without those that hold a benchmark window (``how="document"``), or with the
    hit words cut out of their text, one space in their place (``how="span"``). Columns may have any name."""
    if how not in ("document", "span"):
        raise ValueError(how)
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("text"))
    marked = find_hits(own, benchmark)
    if how == "document":
        return marked.where(F.size("hits") == 0).select("row.*")

    @F.pandas_udf("string")
    def cut(texts, hits):
        out = []
        for t, h in zip(texts, hits):
            if t is None or h is None or not len(h):
                out.append(t)
                continue
            drop, pieces, at = set(int(x) for x in h), [], 0
            for k, m in enumerate(WORD.finditer(t.translate(LOWER))):
                if k in drop:
                    pieces.append(t[at : m.start()] if k - 1 not in drop or not pieces else "")
                    at = m.end()
            pieces.append(t[at:])
            out.append(re.sub(r"[ \t]{2,}", " ", " ".join(p for p in pieces if p)))
        return type(texts)(out)

    return marked.select(*[cut(F.col("text"), F.col("hits")).alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns])
