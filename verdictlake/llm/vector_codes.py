"""Product codes for vectors by dual-tree Lloyd rounds over integers.

Each component becomes floor(1024 * x), and a vector is cut into equal consecutive parts,
each with a codebook of its own. Vectors lie in blocks of at most ``BLOCK`` rows in a table
in the shared folder; with a block goes one balanced tree over its parts at each position,
built once and used by every round. A round meets a block's tree with a tree over the
codebook's entries: of each pair of nodes, bounding boxes give the least and the largest
squared distance, and a pair whose least distance exceeds the largest of another pair of
the same node is pruned. Where one entry is left, the whole node is assigned by its cached
sum; points of leaves that stay uncertain are compared with the entries left by integer
distances. Bounds and distances are integers throughout, so the result is that of plain
Lloyd rounds, ties going to the lower index.

A task returns one sum for each entry, which Spark adds up; only the codebooks (parts times
entries rows) pass through the driver, and nothing is gathered by label but sums.

Edge cases: rows whose vector is null or holds a null, NaN or infinite component are
dropped, and so are vectors without components; a vector of another length than the first one's, or of a length that ``parts``
doesn't divide, is an error, as is a component so large that a distance would not fit a long
(beyond 2**28 / 1024 for up to 16 components a part). Seeds are the rows of the smallest
ids, nulls last, equal ids by their components; fewer rows than ``entries`` make smaller
codebooks. Repeated rows are rows of their own. An empty table gives an empty result. Very
long texts in other columns pass through whole. Other columns pass through; the vector is
replaced by its code, and a clash with an output column is an error before any job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stage, require_free, stage

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK, LEAF = 4096, 32


def bounds(n: int, level: int) -> np.ndarray:
    """Edges of the slices that the nodes of a level have; a node's children halve its slice."""
    return (n * np.arange((1 << level) + 1)) >> level


def tree_order(x: np.ndarray, levels: int) -> np.ndarray:
    """An order of the rows of ``x`` in which every node of a level is a slice, cut at the median of its widest axis."""
    order, n = np.arange(len(x)), len(x)
    for level in range(levels):
        edges = bounds(n, level)
        y = x[order]
        wide = (np.maximum.reduceat(y, edges[:-1]) - np.minimum.reduceat(y, edges[:-1])).argmax(1)
        node = np.repeat(np.arange(len(wide)), np.diff(edges))
        order = order[np.lexsort((y[np.arange(n), wide[node]], node))]
    return order


def depth(n: int, leaf: int) -> int:
    """Levels below the root so that leaves have about ``leaf`` rows and none is empty."""
    return max(0, (n // leaf).bit_length() - 1) if leaf > 1 else max(0, n.bit_length() - 1)


class Tree:
    """Rows in tree order with the box, the sum and the slice of every node of every level."""

    def __init__(self, x: np.ndarray, order: np.ndarray, levels: int, sums: bool = True):
        self.rows, self.order, self.levels = x[order], order, levels
        self.edges = [bounds(len(x), k) for k in range(levels + 1)]
        if not sums and len(self.edges[-1]) <= len(x):
            # entries end as leaves of one; a last level halves the leaves of two
            self.edges.append(np.arange(len(x) + 1))
            self.levels += 1
        fold = [(np.minimum.reduceat(self.rows, e[:-1]), np.maximum.reduceat(self.rows, e[:-1])) for e in self.edges]
        self.low, self.high = [f[0] for f in fold], [f[1] for f in fold]
        self.sums = [np.add.reduceat(self.rows, e[:-1]) for e in self.edges] if sums else []


@dataclass
class Found:
    """The entry of each row of a tree, and sums and counts by entry."""

    entry: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    whole: int  # rows assigned with a node


def assign(points: Tree, entries: Tree) -> Found:
    """The nearest entry of each point, the lower index on ties; entry numbers are those of the codebook."""
    k, width = entries.rows.shape
    found = Found(np.zeros(len(points.rows), np.int64), np.zeros((k, width), np.int64), np.zeros(k, np.int64), 0)
    pl = el = 0
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        near, far = _distances(points, pl, p, entries, el, e)
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        least = np.repeat(np.minimum.reduceat(far, starts), np.diff(np.append(starts, len(p))))
        keep = near <= least
        p, e = p[keep], e[keep]
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        alone = np.diff(np.append(starts, len(p))) == 1
        cuts = entries.edges[el]
        sure = starts[alone & (cuts[e[starts] + 1] - cuts[e[starts]] == 1)]
        if len(sure):
            node, slot = p[sure], entries.order[cuts[e[sure]]]
            edges = points.edges[pl]
            np.add.at(found.sums, slot, points.sums[pl][node])
            size = edges[node + 1] - edges[node]
            np.add.at(found.counts, slot, size)
            out = np.cumsum(size)
            found.entry[np.arange(out[-1]) + np.repeat(edges[node] - out + size, size)] = np.repeat(slot, size)
            found.whole += int(size.sum())
            rest = np.ones(len(p), bool)
            rest[sure] = False
            p, e = p[rest], e[rest]
        if not len(p) or (pl == points.levels and el == entries.levels):
            break
        if el < entries.levels:
            below = np.searchsorted(entries.edges[el + 1], entries.edges[el])
            size = below[e + 1] - below[e]
            out = np.cumsum(size)
            p, e, el = np.repeat(p, size), np.arange(out[-1]) + np.repeat(below[e] - out + size, size), el + 1
        if pl < points.levels:
            # all pairs of a node for its first child, then all for its second
            starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            size = np.diff(np.append(starts, len(p)))
            twice = np.repeat(size, 2)
            out = np.cumsum(twice)
            take = np.arange(out[-1]) + np.repeat(np.repeat(starts, 2) - out + twice, twice)
            p, e, pl = np.repeat(2 * np.repeat(p[starts], 2) + np.tile([0, 1], len(starts)), twice), e[take], pl + 1
    _settle(points, p, entries, e, found)
    return found


def _distances(points: Tree, pl: int, p: np.ndarray, entries: Tree, el: int, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance of the boxes of each pair of nodes."""
    near, far = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
    for at in range(0, len(p), 8192):
        a, b = p[at : at + 8192], e[at : at + 8192]
        up, down = points.high[pl][a] - entries.low[el][b], entries.high[el][b] - points.low[pl][a]
        gap = np.maximum(0, -np.minimum(up, down))
        reach = np.maximum(up, down)
        near[at : at + 8192] = np.einsum("ij,ij->i", gap, gap)
        far[at : at + 8192] = np.einsum("ij,ij->i", reach, reach)
    return near, far


def _settle(points: Tree, p: np.ndarray, entries: Tree, e: np.ndarray, found: Found) -> None:
    """Assign the points of uncertain leaves by integer distances to the entries that are left for the leaf."""
    if not len(p):
        return
    edges = points.edges[-1]
    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    # products of such integers are exact in doubles, which multiply faster
    most = max(np.abs(points.rows).max(), np.abs(entries.rows).max())
    exact = 4 * int(most) ** 2 * points.rows.shape[1] < 1 << 53
    rows = points.rows.astype(np.float64) if exact else points.rows
    book = np.empty_like(entries.rows)
    book[entries.order] = entries.rows
    square = (book * book).sum(1)
    book_t = book.T.astype(np.float64) if exact else book.T
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(p)]):
        first, last = edges[p[a]], edges[p[a] + 1]
        slots = np.sort(entries.order[e[a:b]])
        d = square[slots] - 2 * (rows[first:last] @ book_t[:, slots])
        found.entry[first:last] = slots[d.argmin(1)]
    loose = np.concatenate([np.arange(edges[x], edges[x + 1]) for x in p[starts].tolist()])
    slot = found.entry[loose]
    order = slot.argsort(kind="stable")
    slot = slot[order]
    runs = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    found.sums[slot[runs]] += np.add.reduceat(points.rows[loose[order]], runs)
    found.counts[slot[runs]] += np.diff(np.append(runs, len(slot)))


@dataclass
class Codebooks:
    """parts times entries times width integers."""

    entries: np.ndarray

    def text(self) -> str:
        """All components in decimal by part, entry and position, joined by commas."""
        return ",".join(map(str, self.entries.ravel().tolist()))

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def to_integers(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(id, label, ints, row): usable vectors as integers, with the other columns in ``row``."""
    v = F.col(f"`{vector}`")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    others = [F.col(f"`{c}`") for c in df.columns if c != vector]
    return df.where(fine).select(F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("ints"), F.struct(*others).alias("row")).select(F.col("row")[id_col].alias("id"), F.col("row")[label].alias("label"), "ints", "row")


def blocks_of(ints: DataFrame, parts: int, width: int) -> DataFrame:
    """Blocks of rows with their integers and an order of their parts' tree for each position."""
    most = int((1 << 62) // (4 * width)) ** 0.5
    kind = T.StructType([T.StructField("rows", T.ArrayType(ints.schema["row"].dataType)), T.StructField("ints", T.BinaryType()), T.StructField("orders", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                column = b.column("ints")
                if (np.diff(column.offsets.to_numpy()) != parts * width).any():
                    raise ValueError(f"vectors of other lengths than {parts * width}")
                x = column.flatten().to_numpy().astype(np.int64).reshape(b.num_rows, parts, width)
                if np.abs(x).max() > most:
                    raise ValueError("a component is too large: squared distances would not fit a long")
                orders = np.stack([tree_order(x[:, k], depth(len(x), LEAF)) for k in range(parts)])
                row = b.column("row")
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), row), pa.array([x.astype("<i4").tobytes()], pa.binary()), pa.array([orders.astype("<u2").tobytes()], pa.binary())], ["rows", "ints", "orders"])

    return ints.select("ints", "row").mapInArrow(run, kind)


def _trees(batch: pa.RecordBatch, k: int, parts: int, width: int, sums: bool) -> tuple[np.ndarray, list[Tree]]:
    x = np.frombuffer(batch.column("ints")[k].as_py(), "<i4").astype(np.int64).reshape(-1, parts, width)
    orders = np.frombuffer(batch.column("orders")[k].as_py(), "<u2").reshape(parts, -1).astype(np.int64)
    return x, [Tree(np.ascontiguousarray(x[:, j]), orders[j], depth(len(x), LEAF), sums) for j in range(parts)]


def _entry_trees(books: np.ndarray) -> list[Tree]:
    levels = depth(books.shape[1], 1)
    return [Tree(b, tree_order(b, levels), levels, False) for b in books]


def lloyd_round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: sums by entry from every task, added up by Spark."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _entry_trees(books)
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for j, tree in enumerate(_trees(batch, i, parts, width, True)[1]):
                    found = assign(tree, trees[j])
                    sums[j] += found.sums
                    counts[j] += found.counts
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    folded = blocks.select("ints", "orders").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = folded.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    out = books.copy()
    for r in total.collect():  # at most parts times entries rows
        out[r.part, r.entry] = [s // r.n for s in r.sums]
    return out


def encode_blocks(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows of the blocks with ``code`` (a byte for each part) and ``error``."""
    parts, _, width = books.shape
    kind = T.StructType([*blocks.schema["rows"].dataType.elementType.fields, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _entry_trees(books)
        for batch in batches:
            for i in range(batch.num_rows):
                x, trees = _trees(batch, i, parts, width, True)
                code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for j, tree in enumerate(trees):
                    entry = np.empty(len(x), np.int64)
                    entry[tree.order] = assign(tree, entries[j]).entry
                    code[:, j] = entry
                    gap = x[:, j] - books[j][entry]
                    error += np.einsum("ij,ij->i", gap, gap)
                rows = batch.column("rows").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], kind.fieldNames())

    return blocks.mapInArrow(run, kind)


def compress_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """Usable rows with ``code`` and ``error`` in place of the vector and ``label_error``, and the codebooks.

    ``error`` is the squared distance to the entries of the code, summed over parts;
    ``label_error`` its sum over the rows of equal label, null labels together."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: at most 256 entries")
    require_free(df.drop(vector), ["code", "error", "label_error"])
    ints = to_integers(df, id_col, vector, label)
    seeds = [r.ints for r in ints.select("id", "ints").orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()]
    if not seeds:
        none = df.drop(vector).limit(0).select("*", F.lit(None).cast("binary").alias("code"), *[F.lit(None).cast("long").alias(c) for c in ("error", "label_error")])
        return none, Codebooks(np.zeros((parts, 0, 0), np.int64))
    if len(seeds[0]) % parts or any(len(s) != len(seeds[0]) for s in seeds):
        raise ValueError(f"vectors need one length, divisible by {parts}")
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    blocks = stage(blocks_of(ints, parts, books.shape[2]), "vector_blocks")
    for _ in range(rounds):
        books = lloyd_round(blocks, books)
    coded = stage(encode_blocks(blocks, books), "vector_codes")
    drop_stage(df.sparkSession, blocks)
    totals = coded.groupBy(F.col(f"`{label}`").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col(f"`{label}`").eqNullSafe(F.col("_label"))).drop("_label"), Codebooks(books)


def decode_vectors(df: DataFrame, books: Codebooks, code: str = "code", vector: str = "decoded") -> DataFrame:
    """Add the vector that a code stands for: the middles of its entries' components, scaled back."""
    require_free(df, [vector])
    table = (books.entries + 0.5) / SCALE

    @F.pandas_udf("array<double>")
    def restored(codes):
        return codes.map(lambda c: None if c is None else np.concatenate([table[k][b] for k, b in enumerate(c)]))

    return df.withColumn(vector, restored(F.col(code)))
