"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint has 64 bits over a ring of five segments. If two fingerprints differ
in at most two bits, some chain of consecutive segments starting at segment i keeps
within the proportional budget at every length l: at most floor(2 l / 5) differing
bits, that is 0, 0, 1, 1, 2. So both share segments i and i + 1 exactly: buckets on
these two segments hold every pair, and the longer chains prune candidates before
the full Hamming check.

Equal fingerprints are one node from the start, so copies cost nothing. A bucket of
up to ``bucket_max`` fingerprints is searched whole in one task, which returns a
spanning forest and not the pairs. Larger buckets take an exact way for the rest:
two fingerprints differ in at most two bits if and only if some 64-bit value is
within one bit of both, so each fingerprint is sent to its 65 such values, where at
most 65 can meet, and is linked to the smallest there.

Edge cases: a null or blank text has fingerprint zero and is linked like any other;
texts of one or two words are one shingle; a very long text is shingled whole; rows with a null id take part and count
as larger than any id, alone they have a null component_id; an empty table gives an
empty result; repeated rows give repeated results, of which ``dedup_near`` leaves one;
other columns pass through it under any name and are not read by ``near_components``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_key, slices, stage
from .components import components

BITS, SEGMENTS = 64, 5
MAX_DIFF = 2
BUCKET_MAX = 512
SEED = 42


def shingle_hashes(text: str, width: int = 3) -> list[int]:
    """XXH64 of every word shingle; ASCII capitals count as small letters."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    return [h(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[width - 1 :])]


def fingerprint_of(h: np.ndarray) -> np.uint64:
    """The fingerprint of a text's shingle hashes; zero without any."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 65536):
        part = h[a : a + 65536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]


def fingerprints_of(texts: list[str], width: int = 3) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text."""
    return np.array([fingerprint_of(np.array(shingle_hashes(t, width), np.uint64)) for t in texts], np.uint64)


def simhash(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text, 2_000_000):
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fingerprints_of(texts, width).view(np.int64))], [id_col, "fp"])

    return df.select(id_col, text).mapInArrow(run, T.StructType([df.schema[id_col], T.StructField("fp", T.LongType())]))


def _segments() -> list[int]:
    """Bit masks of the segments, lowest bits first."""
    cuts = [round(i * BITS / SEGMENTS) for i in range(SEGMENTS + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def _chains(start: int) -> list[tuple[int, int]]:
    """(mask, budget) of the chains of growing length from segment ``start``."""
    masks, out, m = _segments(), [], 0
    for n in range(1, SEGMENTS + 1):
        m |= masks[(start + n - 1) % SEGMENTS]
        out.append((m, MAX_DIFF * n // SEGMENTS))
    return out


def _exact_length() -> int:
    """Segments at the head of a chain whose budget is zero."""
    return sum(1 for _, b in _chains(0) if b == 0)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) of a spanning forest of the links between the fingerprints of a bucket."""
    fps = np.unique(fps.view(np.uint64))
    label = np.arange(len(fps))
    chains = _chains(start)[_exact_length() :]
    left, right = [], []
    for i in range(len(fps) - 1):
        diff = fps[i] ^ fps[i + 1 :]
        near = np.arange(i + 1, len(fps))
        for mask, budget in chains:
            ok = np.bitwise_count(diff & np.uint64(mask)) <= budget
            diff, near = diff[ok], near[ok]
        for j in near:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                left.append(i)
                right.append(j)
    return fps[left].view(np.int64), fps[right].view(np.int64)


def links(nodes: DataFrame, bucket_max: int = BUCKET_MAX) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints (column fp, distinct) linked at two or fewer differing bits."""
    head = _exact_length()
    keys = [F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(_signed(_chains(i)[head - 1][0]))).alias("val")) for i in range(SEGMENTS)]
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.seg", "key.val")
    sizes = rows.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stage(rows.join(sizes, ["seg", "val"]), "buckets")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for start, fps in zip(batch.column("seg").to_pylist(), batch.column("fps")):
                a, b = forest(fps.values.to_numpy(zero_copy_only=False).astype(np.int64), start)
                u.append(a)
                v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    small = shared.where(F.col("size") <= bucket_max).groupBy("seg", "val").agg(F.collect_list("fp").alias("fps")).select("seg", "fps").mapInArrow(search, "u long, v long")
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(BITS)])
    meet = shared.where(F.col("size") > bucket_max).select("fp").distinct().select("fp", F.explode(near).alias("z"))
    large = meet.select(F.col("fp").alias("u"), F.min("fp").over(Window.partitionBy("z")).alias("v")).where("u <> v")
    return small.unionByName(large)


def near_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, bucket_max: int = BUCKET_MAX) -> DataFrame:
    """(id, fingerprint, component_id) for every row; component_id is the smallest id reachable."""
    prints = stage(simhash(df, id_col, text, width), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), bucket_max))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.where("root <> fp").groupBy("root").agg(F.min("first").alias("low"))
    named = joined.join(least, "root", "left").select("fp", F.when(F.col("root") == F.col("fp"), F.least("first", "low")).alias("own"), "root")
    best = named.where("own is not null").select(F.col("root").alias("r"), F.col("own").alias("component_id"))
    by_fp = named.select("fp", "root").join(best, F.col("root") == F.col("r"), "left").select("fp", "component_id")
    return prints.join(by_fp, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup_near(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, similar: bool = False) -> DataFrame:
    """One row of each component, with the columns of ``df``: that of the smallest id, an id before none,
    of several with this id the one whose digest over all columns is smallest.

    With ``similar`` texts link if the Jaccard similarity of their shingle sets is 0.8 or more: linked
    fingerprints are candidates, and prefix filtering adds those that fingerprints can't find."""
    if similar:
        from .similar import dedup_similar

        return dedup_similar(df, id_col, text, width)
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"), row_key(df).alias("key"))
    prints = stage(simhash(keyed, "key", "text", width), "fingerprints")
    return keep_first(keyed, prints.join(_roots(prints), "fp").select("key", "root"))


def _roots(prints: DataFrame) -> DataFrame:
    """(fp, root) of every distinct fingerprint."""
    nodes = prints.select("fp").distinct()
    roots = components(links(nodes))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def keep_first(keyed: DataFrame, members: DataFrame) -> DataFrame:
    """keyed (row, id, key), members (key, root): the row of the smallest id and key of each root."""
    some = keyed.select("id", "key").join(members.distinct(), "key")
    first = some.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    stay = first.select(F.col("first.key").alias("key"))
    return keyed.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
