"""Near-duplicates by the Jaccard similarity of word shingles, found without loss.

Two texts are alike if their sets of five-word shingles have a Jaccard similarity of 0.8
or more. Prefix filtering finds every such pair: under any order of all shingles, two
sets that share enough have a common shingle among the first n - ceil(0.8 n) + 1 of
each. Shingles that are frequent in a sample come last in that order, so passages and
lines that many texts share seldom bring texts together; the order decides about cost
and never about the result. Sizes and places of the common shingle rule out most pairs,
the rest are compared by their texts.

Equal sets are one node from the start. Texts whose SimHash fingerprints the pigeonring
search links are compared first, which settles close copies; fingerprints alone can't find
the rest, since texts of similarity 0.8 differ in ten bits and more. Of the texts that meet
at a shingle each is then compared with one hub, the text with the fewest rarer shingles
before it, which joins a large group around its source in as many comparisons as it has
members. Only texts that are still apart are compared pair by pair, and of these the join
itself drops most: a shingle in one set alone flips one of 256 parity bits, so sets whose
bits differ in more than a ninth of their sizes can't be alike. Sets of some 500 shingles
and more have so large a ninth that 256 bits hardly tell them apart; in the comparison pair
by pair 1,024 bits take their place, which do for sizes up to four times as large.

Edge cases: blank texts have one shingle in common; texts below the width are one
shingle; a very long text is shingled and compared whole; rows with a null id take part and count as larger than any id; repeated rows are
one; other columns pass through under any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stage, row_key, slices, stage
from .components import components
from .simhash import SEED, fingerprint_of, keep_first, links, shingle_hashes

WIDTH = 5
#: similarity of at least NUM / DEN
NUM, DEN = 4, 5
SAMPLE, FREQUENT, MOST = 20_000, 4, 300_000
FEW_NODES = 500_000
PARITY = tuple(f"b{k}" for k in range(4))
WIDE = tuple(f"w{k}" for k in range(16))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes in ascending order; a blank text has one of its own."""
    return np.unique(_shingles(text, width))


def _shingles(text: str | None, width: int) -> np.ndarray:
    return np.array(shingle_hashes(text or "", width) or [xxhash.xxh64_intdigest(b"", SEED)], np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * common >= NUM * (len(a) + len(b) - common)


def parity_bits(h: np.ndarray, slots: int = 64 * len(PARITY)) -> np.ndarray:
    """64-bit words: for each of the slots, whether an odd number of the set's shingles fall into it; slots are the hash's top bits."""
    odd = np.bincount((h >> np.uint64(65 - slots.bit_length())).astype(np.int64), minlength=slots) % 2
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _frequent(df: DataFrame, text: str, width: int) -> Broadcast:
    """(hashes, ranks) of shingles that several texts of a sample share, ascending by hash; the most frequent rank highest."""
    step = max(1, df.count() // SAMPLE)
    some = df.where(F.pmod(F.xxhash64(text), F.lit(step)) == 0).select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in (x for b in batches for x in slices([b], text, 1_000_000)):
            h = np.concatenate([shingle_set(t, width) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    counts = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT)
    top = counts.orderBy(F.desc("count"), "h").limit(MOST).toArrow()
    h = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return df.sparkSession.sparkContext.broadcast((h[order], top["count"].to_numpy().astype(np.int64)[order]))


def prefix(h: np.ndarray, known: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set that two sets alike can't both lack."""
    rank = np.zeros(len(h), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        rank = np.where(known[at] == h, ranks[at], 0)
    least = -(-NUM * len(h) // DEN)
    return h[np.lexsort((h, rank))][: len(h) - least + 1]


def sets(df: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(id, fp, node, n, heads, b0 to b3, w0 to w15, body): node names the set of n shingles, heads is its prefix, body the text, b and w are parity bits."""
    shared = _frequent(df, text, width)
    schema = T.StructType([df.schema[id_col], T.StructField("fp", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("heads", T.ArrayType(T.LongType())), *[T.StructField(b, T.LongType()) for b in PARITY + WIDE], T.StructField("body", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = shared.value
        for batch, texts in slices(batches, text, 2_000_000):
            every = [_shingles(t, width) for t in texts]
            fp = np.array([fingerprint_of(h) for h in every], np.uint64).view(np.int64)
            own = [np.unique(h) for h in every]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in own], np.uint64).view(np.int64)
            heads = pa.array([prefix(h, known, ranks).view(np.int64) for h in own], pa.list_(pa.int64()))
            bits = np.concatenate([np.array([parity_bits(h, 64 * len(c)) for h in own], np.int64).reshape(-1, len(c)) for c in (PARITY, WIDE)], 1)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fp), pa.array(node), pa.array([len(h) for h in own], pa.int64()), heads, *(pa.array(bits[:, k].copy()) for k in range(bits.shape[1])), pa.array(texts, pa.string())], schema.names)

    return df.select(id_col, text).mapInArrow(run, schema)


def _possible(a: str, b: str, bits: tuple[str, ...] = PARITY) -> Column:
    """Whether two sets that meet at these places can be alike: by what is left behind the places, and by parity bits."""
    x, y = (lambda c, t=t: F.col(f"{t}.{c}") for t in (a, b))
    rest = F.least(x("n") - x("at"), y("n") - y("at"))
    differ = sum((F.bit_count(x(c).bitwiseXOR(y(c))) for c in bits), F.lit(0))
    # alike sets have at least NUM / (NUM + DEN) of their sizes in common and what is left apart
    return ((DEN + NUM) * rest >= NUM * (x("n") + y("n"))) & ((DEN + NUM) * differ <= (DEN - NUM) * (x("n") + y("n")))


def _verify(pairs: DataFrame, bodies: DataFrame, width: int) -> DataFrame:
    """The pairs (u, v) whose texts are alike."""
    used = stage(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "used")
    # texts that no pair names don't leave the map side; a node is one long
    used = F.broadcast(used) if used.count() <= FEW_NODES else used
    texts = bodies.join(used, "node", "left_semi").groupBy("node").agg(F.first("body").alias("body"))
    first = pairs.join(texts.select(F.col("node").alias("u"), F.col("body").alias("a")), "u")
    both = first.join(texts.select(F.col("node").alias("v"), F.col("body").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, held, ok = None, None, []
            for u, a, b in zip(batch.column("u").to_pylist(), batch.column("a"), batch.column("b")):
                if u != last:
                    last, held = u, shingle_set(a.as_py(), width)
                ok.append(alike(held, shingle_set(b.as_py(), width)))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes whose fingerprints are equal or linked, one node standing for each fingerprint."""
    nodes = stage(prints.groupBy("fp").agg(F.min("node").alias("rep")), "nodes")
    same = prints.select("fp", F.col("node").alias("u")).join(nodes, "fp").select("u", F.col("rep").alias("v"))
    near = links(nodes.select("fp")).withColumnsRenamed({"u": "a", "v": "b"})
    for fp, name in (("a", "u"), ("b", "v")):
        near = near.join(nodes.select(F.col("fp").alias(fp), F.col("rep").alias(name)), fp)
    both = same.unionByName(near.select("u", "v")).where("u <> v")
    return both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _pairs(met: DataFrame, left: str, right: str) -> DataFrame:
    u, v = F.col(f"{left}.node"), F.col(f"{right}.node")
    return met.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()


def similar_edges(prints: DataFrame, width: int = WIDTH) -> DataFrame:
    """Edges (u, v) that connect exactly the nodes that chains of texts alike connect."""
    nodes = prints.select("node", "n", *PARITY).distinct()
    flat = prints.select("node", F.posexplode("heads").alias("at", "head")).withColumn("at", F.col("at").cast("long"))
    shared = flat.groupBy("head").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("head")
    rows = stage(flat.join(shared, "head").distinct().join(nodes, "node"), "heads")
    bodies = prints.select("node", "body")
    hubs = rows.groupBy("head").agg(F.min_by(F.struct("node", "n", "at", *PARITY), F.struct("at", "n", "node")).alias("h")).select("head", "h.*")
    near = rows.alias("r").join(hubs.alias("h"), "head").where("r.node <> h.node").where(_possible("r", "h"))
    first = stage(fingerprint_pairs(prints).unionByName(_pairs(near, "r", "h")).distinct(), "pairs")
    edges = stage(_verify(first, bodies, width), "alike")
    roots = stage(components(edges), "roots")
    placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # only shingles where more than one component meets
    mixed = placed.groupBy("head").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("head")
    wide = prints.select("node", *WIDE).distinct()
    left = stage(placed.drop(*PARITY).join(mixed, "head").join(wide, "node"), "apart")
    for used in (rows, roots):
        drop_stage(prints.sparkSession, used)
    meet = left.alias("a").join(left.alias("b"), "head").where("a.node > b.node and a.root <> b.root").where(_possible("a", "b", WIDE))
    rest = stage(_pairs(meet, "a", "b").join(first, ["u", "v"], "left_anti"), "pairs")
    both = stage(edges.unionByName(_verify(rest, bodies, width)), "edges")
    for used in (first, left, rest, edges):
        drop_stage(prints.sparkSession, used)
    return both


def dedup_similar(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row of each group of texts that chains of texts alike connect, with the columns of ``df``: that of the
    smallest id, an id before none, of several with this id the one whose digest over all columns is smallest."""
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"), row_key(df).alias("key"))
    prints = stage(sets(keyed, "key", "text", width), "sets")
    roots = stage(components(similar_edges(prints, width)), "roots")
    members = stage(prints.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root")), "members")
    drop_stage(df.sparkSession, prints)
    return keep_first(keyed, members)
