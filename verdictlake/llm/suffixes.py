"""Suffix-array deduplication of bytes: threshold-bounded interval expansion on Burrows-Wheeler transforms.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier is removed.

Suffixes are dealt to shards so that equal strings of LENGTH bytes meet. Of such a string's
grams of ``GRAM`` bytes the one with the smallest hash, the leftmost on ties, is its
minimizer: it depends on the string alone, so equal strings have equal minimizers at equal
distances. Neighbouring strings share a minimizer, and what they cover is its context, some
130 bytes. Minimizers are counted corpus-wide first; only contexts of repeated ones are kept.
Copies of a context, by 64 bits of its minimizer and 64 of its bytes, are folded with partial
sums: the first by place stays for comparison, and of the others every string has an earlier
copy. What is left are different contexts with a common minimizer; their bytes are cut from the
texts and go to shards of about ``SHARD_BYTES``.

A shard's contexts, in order of place, are one text. Its suffixes are sorted by their first
128 bytes, which gives its Burrows-Wheeler transform. Starting from the empty string, all
intervals of a length are extended by one byte to the left at once; where an interval's end
has no common prefix value yet, it gets the current length, and the interval lives on. Values
thus come in increasing order, and the search stops at LENGTH: neighbours without a value
share at least LENGTH bytes. Of each run of such neighbours the smallest place is the first
occurrence, and all others are removed.

A minimizer with more than ``CROWD`` different contexts, such as a line that many documents
have, would crowd a shard. Its strings are dealt anew by where the minimizer lies in them, in
halves: all strings of a half have further bytes in common, which become the new key; copies
are folded again, and so on down to single strings, which folding settles alone.

Matches never cross rows. Places are ordered by id (none last, as is an id of 2**63 - 1), then
by the order in which rows are first written to the shared folder, then by position; so of rows
that share an id or have none, or repeated rows, the first one written stays. Null texts count as
empty, a text below LENGTH bytes loses nothing, and very long texts are processed whole, in a
batch of their own. Text may be cut within a character, so what remains is binary. An empty
table gives an empty result. Other columns pass through, and a clash with an output column is an
error before any job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stage, release, require_free, slices, stage

LENGTH, GRAM, DEPTH = 100, 32, 128
REACH = LENGTH - GRAM + 1  # grams of a string
SHARD_BYTES, CROWD, SLICE_CHARS = 1_000_000, 1000, 500_000
LAST_ID = (1 << 63) - 1

_BYTE = np.random.default_rng(100).integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = np.random.default_rng(32).integers(0, 1 << 64, 8, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of all grams, by doubling."""
    h, width = _BYTE[data], 1
    for odd in _ODD:
        if width == GRAM:
            break
        h = h[:-width] * odd + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= _ODD[7]
    h ^= h >> np.uint64(29)
    return h


def minimizers(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie in one array: (text, minimizer's hash, first start, starts, distance of the minimizer from the first start).

    One row for each run of neighbouring strings with one minimizer; starts count from the text's beginning."""
    begins = np.cumsum(sizes) - sizes
    long = np.flatnonzero(sizes >= LENGTH)
    if not len(long):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    h = gram_hashes(data)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < REACH:
        low = np.minimum(low[: len(low) - (REACH - width)], low[REACH - width :])
    count = sizes[long] - LENGTH + 1
    out = np.cumsum(count)
    starts = np.arange(out[-1]) + np.repeat(begins[long] - out + count, count)
    at = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1]
    fresh[out[:-1]] = True
    first = np.flatnonzero(fresh)
    text = np.repeat(long, count)[first]
    return text, h[at[first]], starts[first] - begins[text], np.diff(np.append(first, len(at))), at[first] - starts[first]


def _joined(texts: list[str]) -> tuple[bytes, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return b"".join(raw), np.array([len(r) for r in raw], np.int64)


def minimizer_rows(numbered: DataFrame) -> DataFrame:
    """(gram, digest, id, number, place) of every context; ``place`` packs its first start, its starts and its minimizer's distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", SLICE_CHARS):
            raw, sizes = _joined(texts)
            text, gram, start, count, lead = minimizers(np.frombuffer(raw, np.uint8), sizes)
            begin = start + (np.cumsum(sizes) - sizes)[text]
            digest = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begin.tolist(), (begin + count + LENGTH - 1).tolist())]
            row = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(np.array(digest, np.uint64).view(np.int64)), batch.column("id").take(row), batch.column("number").take(row), pa.array(start << 16 | count << 8 | lead)], ["gram", "digest", "id", "number", "place"])

    return numbered.select("id", "number", "text").mapInArrow(run, "gram long, digest long, id long, number long, place long")


def contexts(numbered: DataFrame, places: DataFrame) -> DataFrame:
    """(gram, crowded, id, number, start, starts, lead, body): the bytes behind places of ``places``, which has them by row."""
    joined = numbered.select("number", "id", "text").join(places, "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", SLICE_CHARS):
            row, columns, body = [], [], []
            for k, (t, found) in enumerate(zip(texts, batch.column("places"))):
                raw = t.encode("utf-8", "surrogatepass")
                place = found.values.field("place").to_numpy()
                s, n = place >> 16, place >> 8 & 255
                row += [k] * len(s)
                columns.append((found.values.field("gram").to_numpy(), found.values.field("crowded").to_numpy(zero_copy_only=False), s, n, place & 255))
                body += [raw[a:b] for a, b in zip(s.tolist(), (s + n + LENGTH - 1).tolist())]
            if row:
                which = pa.array(row, pa.int64())
                gram, crowded, start, count, lead = (pa.array(np.concatenate(x)) for x in zip(*columns))
                yield pa.RecordBatch.from_arrays([gram, crowded, batch.column("id").take(which), batch.column("number").take(which), start, count, lead, pa.array(body, pa.binary())], ["gram", "crowded", "id", "number", "start", "starts", "lead", "body"])

    return joined.mapInArrow(run, "gram long, crowded boolean, id long, number long, start long, starts long, lead long, body binary")


# ---- one shard ------------------------------------------------------------------------------


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """Suffixes in the order of their first DEPTH symbols, beyond the end zeros; ties in any order."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : n + k]
    width = 8
    while True:
        order = key.argsort(kind="stable")
        ranked = key[order]
        fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        if width >= DEPTH or fresh.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh).astype(np.uint64)
        key = rank << np.uint64(32)
        key[:-width] |= rank[width:]
        width *= 2


def short_prefixes(text: np.ndarray, order: np.ndarray, stop: int = LENGTH) -> np.ndarray:
    """Whether the common prefix of each suffix with the one before it in order is shorter than ``stop``.

    Breadth-first backward extension over the Burrows-Wheeler transform. Symbol zero separates
    contexts: no string goes on to the left of it."""
    n = len(text)
    before = text[order - 1]
    by_symbol = before.argsort(kind="stable")
    step = np.empty(n, np.int64)  # from a row of the transform to the row of the suffix one symbol longer
    step[by_symbol] = np.arange(n)
    symbol = before[by_symbol]  # first symbols of the sorted suffixes
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    owner = np.zeros(n, np.int64)
    low, high = np.zeros(1, np.int64), np.full(1, n)
    for length in range(stop):
        # intervals of strings of this length; each gives one interval for each symbol before it
        size = high - low
        out = np.cumsum(size)
        rows = np.arange(out[-1]) + np.repeat(low - out + size, size)
        whose = np.repeat(np.arange(len(low)), size)
        if length:
            inner = before[rows] != 0
            rows, whose = rows[inner], whose[inner]
        if not len(rows):
            break
        target = step[rows]
        owner[target] = whose
        target.sort()
        of, s = owner[target], symbol[target]
        cut = np.flatnonzero((target[1:] != target[:-1] + 1) | (of[1:] != of[:-1]) | (s[1:] != s[:-1]))
        low, high = target[np.append(0, cut + 1)], target[np.append(cut, len(target) - 1)] + 1
        # at length zero the last interval ends where everything ends
        fresh = ~known[high] if length else np.ones(len(high), bool)
        low, high = low[fresh], high[fresh]
        known[high] = True
        if not len(low):
            break
    return known[:n]


def later_strings(bodies: list[bytes], starts: np.ndarray) -> np.ndarray:
    """Of contexts in order of place, which of their strings occurred before: one flag for each start, context by context."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    used = np.zeros(256, bool)
    used[data] = True
    if used[1:].all():
        raise ValueError("texts are UTF-8, which doesn't use every byte")
    # symbols from one on in the order of bytes; zero is left for separators
    text = np.cumsum(used).astype(np.uint8)[data]
    if not any(b"\0" in b for b in bodies):
        text -= 1
    text[begins + sizes] = 0
    order = sorted_suffixes(text)
    group = np.cumsum(short_prefixes(text, order))
    valid = np.zeros(len(text), bool)
    out = np.cumsum(starts)
    valid[np.arange(out[-1]) + np.repeat(begins - out + starts, starts)] = True
    rows = np.flatnonzero(valid[order])
    at, group = order[rows], group[rows]
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    first = np.repeat(np.minimum.reduceat(at, edges), np.diff(np.append(edges, len(at))))
    later = np.zeros(len(text), bool)
    later[at[at != first]] = True
    return later[valid]


def shard_spans(mixed: DataFrame, shards: int) -> DataFrame:
    """(number, begin, finish) of the strings of a shard's contexts that occurred before."""

    def compare(found: pa.Table) -> pa.Table:
        found = found.sort_by([("id", "ascending"), ("number", "ascending"), ("start", "ascending")])
        starts = found.column("starts").to_numpy()
        later = later_strings(found.column("body").to_pylist(), starts)
        # runs of flags within a context
        context = np.repeat(np.arange(len(starts)), starts)
        offset = np.arange(len(later)) - np.repeat(np.cumsum(starts) - starts, starts)
        edge = np.flatnonzero(later)
        if len(edge):
            new = np.concatenate([[True], (edge[1:] != edge[:-1] + 1) | (context[edge[1:]] != context[edge[:-1]])])
            a, b = edge[new], edge[np.append(new[1:], True)]
        else:
            a = b = edge
        start, number = found.column("start").to_numpy(), found.column("number").to_numpy()
        which = context[a]
        return pa.table({"number": number[which], "begin": start[which] + offset[a], "finish": start[which] + offset[b] + LENGTH})

    return mixed.select(F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard"), "id", "number", "start", "starts", "body").groupBy("shard").applyInArrow(compare, "number long, begin long, finish long")


# ---- the whole table ------------------------------------------------------------------------


def _halves(rows: DataFrame) -> DataFrame:
    """Contexts whose strings have their minimizer from ``near`` to ``far`` bytes behind their start, dealt to the halves of that range."""
    middle = F.shiftright(F.col("near") + F.col("far"), 1)

    def half(near: Column, far: Column) -> Column:
        begin = F.greatest(F.lit(0).cast("long"), F.col("lead") - far)
        count = F.least(F.col("starts") - 1, F.col("lead") - near) - begin + 1
        shared = F.substring("body", (F.col("lead") - near + 1).cast("int"), (LENGTH - (far - near)).cast("int"))
        body = F.substring("body", (begin + 1).cast("int"), (count + LENGTH - 1).cast("int"))
        moved = {"id": F.col("id"), "number": F.col("number"), "start": F.col("start") + begin, "starts": count, "lead": F.col("lead") - begin, "near": near, "far": far, "body": body}
        return F.struct(F.xxhash64("gram", near, shared).alias("gram"), *[c.alias(n) for n, c in moved.items()])

    return rows.select(F.explode(F.array(half(F.col("near"), middle), half(middle + 1, F.col("far")))).alias("h")).select("h.*").where("starts > 0")


def _release(df: DataFrame) -> DataFrame:
    """``df``, a staged table: the shuffle files behind it can go."""
    release(df.sparkSession)
    return df


def _crowds(firsts: DataFrame) -> DataFrame:
    """Minimizers with several different contexts, and whether these would crowd a shard; with one context nothing is left to compare."""
    return firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1").select("gram", (F.col("contexts") > CROWD).alias("crowded"))


def removed_spans(numbered: DataFrame) -> list[DataFrame]:
    """Staged tables of (number, begin, finish), overlapping: the bytes to remove from each row of ``numbered`` (number, id, text)."""
    spark = numbered.sparkSession
    places = minimizer_rows(numbered)
    # written first, so that a frequent gram's side of the join below is a plain exchange, which can be split
    repeated = _release(stage(places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "repeated"))
    found = _release(stage(places.join(repeated, "gram", "left_semi"), "places"))
    drop_stage(spark, repeated)
    place = F.struct("id", "number", "place")
    firsts = _release(stage(found.groupBy("gram", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")), "firsts"))
    again = found.join(firsts.where("copies > 1").drop("copies"), ["gram", "digest"]).where((F.col("number") != F.col("first.number")) | (found["place"] != F.col("first.place")))
    begin, count = F.shiftright(found["place"], 16), F.shiftright(found["place"], 8).bitwiseAND(F.lit(255))
    out = [_release(stage(again.select("number", begin.alias("begin"), (begin + count + LENGTH - 1).alias("finish")), "spans"))]
    mixed = firsts.join(_crowds(firsts), "gram").groupBy("first.number").agg(F.collect_list(F.struct("gram", "crowded", "first.place")).alias("places"))
    level = _release(stage(contexts(numbered, mixed).select("*", F.lit(0).cast("long").alias("near"), F.lit(REACH - 1).cast("long").alias("far")), "contexts"))
    drop_stage(spark, found)
    drop_stage(spark, firsts)
    while True:
        # contexts of each minimizer are different here; a few are compared, many are dealt on
        size = {r.crowded: r.bytes for r in level.groupBy("crowded").agg(F.sum(F.length("body") + 1).alias("bytes")).collect()}
        if False in size:
            out.append(_release(stage(shard_spans(level.where("not crowded"), -(-size[False] // SHARD_BYTES)), "spans")))
        if True not in size:
            drop_stage(spark, level)
            return out
        halves = stage(_halves(level.where("crowded")), "halves")
        drop_stage(spark, level)
        place = F.struct("id", "number", "start", "starts", "lead", "near", "far")
        firsts = stage(halves.groupBy("gram", "body").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")), "firsts")
        again = halves.join(firsts.where("copies > 1").drop("copies"), ["gram", "body"]).where((F.col("number") != F.col("first.number")) | (halves["start"] != F.col("first.start")))
        out.append(stage(again.select("number", halves["start"].alias("begin"), (halves["start"] + halves["starts"] + LENGTH - 1).alias("finish")), "spans"))
        # a range of one distance has no halves: its strings are alike but for colliding keys
        level = _release(stage(firsts.join(_crowds(firsts), "gram").select("gram", (F.col("crowded") & (F.col("first.near") < F.col("first.far"))).alias("crowded"), "first.*", "body"), "contexts"))
        drop_stage(spark, halves)
        drop_stage(spark, firsts)


def merged(begin: np.ndarray, finish: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal spans in order."""
    order = begin.argsort(kind="stable")
    begin, finish = begin[order], np.maximum.accumulate(finish[order])
    new = np.concatenate([[True], begin[1:] > finish[:-1]])
    return begin[new], finish[np.append(new[1:], True)]


def remove_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows with n_bytes, n_removed, ``spans`` (array of begin and finish, in bytes of the whole text) and ``kept`` (binary) in place of the text."""
    require_free(df.drop(text), ["n_bytes", "n_removed", "spans", "kept"])
    spark = df.sparkSession
    others = [c for c in df.columns if c != text]
    identity = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID))
    numbered = stage(df.select(F.monotonically_increasing_id().alias("number"), identity.alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")), "numbered")
    parts = removed_spans(numbered)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    by_row = every.groupBy("number").agg(F.collect_list("begin").alias("begins"), F.collect_list("finish").alias("finishes"))
    joined = numbered.select("number", "text", "row").join(by_row, "number", "left").select("row", "text", "begins", "finishes")
    span = pa.list_(pa.struct([("begin", pa.int64()), ("finish", pa.int64())]))
    spans_kind = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("finish", T.LongType())]))
    added = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("spans", spans_kind), ("kept", T.BinaryType())]
    kind = T.StructType([*numbered.schema["row"].dataType.fields, *[T.StructField(n, t) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", SLICE_CHARS):
            sizes, removed, spans, kept = [], [], [], []
            for t, begins, finishes in zip(texts, batch.column("begins"), batch.column("finishes")):
                raw = t.encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                if not begins.is_valid:
                    removed.append(0)
                    spans.append([])
                    kept.append(raw)
                    continue
                a, b = (x.tolist() for x in merged(begins.values.to_numpy(), finishes.values.to_numpy()))
                removed.append(sum(b) - sum(a))
                spans.append([{"begin": x, "finish": y} for x, y in zip(a, b)])
                kept.append(b"".join([raw[x:y] for x, y in zip([0, *b], [*a, len(raw)])]))
            rows = batch.column("row")
            yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], kind.fieldNames())

    return joined.mapInArrow(run, kind)
