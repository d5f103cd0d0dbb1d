"""Token-id files compressed by Re-Pair grammars, with random access to every document and token.

Documents are range-partitioned and sorted by id, encoded with the tokenizers library
(distinct words once per worker), given an end id, and cut into shards of about
``shard_tokens`` ids. In every shard rounds of pair replacement follow: the adjacent
pairs that occur at least ``min_count`` times become nonterminals, of overlapping pairs
the more frequent one wins, until no pair is that frequent. After the first round only
pairs that were frequent before or touch a new symbol can be, so later rounds look at
those alone. No pair spans two documents.

The file format is a Parquet table of shards, written by Spark's committers and so safe
against lost executors: part, shard, start (ids before the shard within its part),
doc_ids, doc_tokens, width (bytes of a symbol, 2 or 4), rules (pairs of little-endian
unsigned symbols; rule k is symbol ``n_ids`` + k), rule_lengths (ids each rule expands to,
unsigned 32-bit) and symbols. The sums of the symbols' lengths find the symbols behind
any range of ids, and only the rules that these need are expanded.

Edge cases: a null text counts as empty and has the end id alone; null ids sort first;
rows that share an id are ordered by their text's hash; an empty table gives an empty
file and no rows; a very long text is encoded and stored whole; other columns are not stored,
whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import slices

SCHEMA = (
    "part int, shard int, start long, n_tokens long, doc_ids array<long>, doc_tokens array<int>, "
    "n_ids int, width int, rules binary, rule_lengths binary, symbols binary"
)
END_ID = 2
SHARD_TOKENS = 1_000_000
MIN_COUNT = 24
JOINED_WORDS = 200
NARROW, WIDE = 1 << 16, 1 << 31


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def compress(ids: np.ndarray, doc_tokens: np.ndarray, n_ids: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols) of a shard's ids: no pair within a document occurs ``min_count`` times in the symbols."""
    sym = ids.astype(np.uint32)
    last = np.zeros(len(sym), bool)
    last[np.cumsum(doc_tokens) - 1] = True
    rules = [np.zeros((0, 2), np.uint32)]
    made = n_ids
    live = ~last[:-1]  # places whose pair may be frequent
    while len(sym) > 1:
        at = np.flatnonzero(live)
        key = _keys(sym, at, made)
        ordered = np.sort(key)
        head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
        count = np.diff(np.append(head, len(ordered)))
        pairs, count = ordered[head[count >= min_count]], count[count >= min_count]
        none = len(pairs)
        if not none:
            break
        order = np.argsort(-count, kind="stable")
        rank = np.empty(none, np.int32)
        rank[order] = np.arange(none)
        which = _find(pairs, key)
        found = np.flatnonzero(which < none)
        place = np.full(len(sym) + 1, none, np.int32)  # place[i + 1] is the rank of the pair at i
        place[at[found] + 1] = rank[which[found]]
        here = place[1:-1]
        after = np.concatenate([here[1:], [none]])
        wins = (here < place[:-2]) & (here <= after)
        twin = np.flatnonzero((here == place[:-2]) & (here < none))
        if len(twin):
            # a run of one symbol (a a a a) is one pair at many places: every second one counts
            first = np.concatenate([[True], np.diff(twin) > 1])
            head = twin[first] - 1
            runs = np.diff(np.append(np.flatnonzero(first), len(twin)))
            offset = twin - np.repeat(head, runs)
            leads = np.repeat(here[head] < place[head], runs)
            wins[twin] = (offset % 2 == 0) & leads & (here[twin] <= after[twin])
        take = np.flatnonzero(wins)
        # the most frequent pair loses no place but to itself, at most half of them: some rule is made in every round
        good = np.bincount(here[take], minlength=none) >= min(4, (min_count + 1) // 2)
        take = take[good[here[take]]]
        number = np.cumsum(good) - 1 + made
        pick = pairs[order[good]]
        half = pick.dtype.type(8 * pick.dtype.itemsize // 2)
        rules.append(np.stack([pick >> half, pick & ((pick.dtype.type(1) << half) - pick.dtype.type(1))], 1).astype(np.uint32))
        sym[take] = number[here[take]]
        maybe = np.append(here < none, False)
        maybe[take] = True  # a new symbol and what follows it
        maybe[take[take > 0] - 1] = True
        keep = np.ones(len(sym), bool)
        keep[take + 1] = False
        last[take] = last[take + 1]
        kept = np.flatnonzero(keep)
        sym, last, maybe = sym[kept], last[kept], maybe[kept]
        live = (maybe & ~last)[:-1]
        made += int(good.sum())
        if made > WIDE:
            raise ValueError("too many symbols")
    return np.concatenate(rules), sym


def _keys(sym: np.ndarray, at: np.ndarray, made: int) -> np.ndarray:
    """Pairs at these places as one integer, the left symbol in the upper half."""
    if made <= NARROW:
        return (sym[at] << np.uint32(16)) | sym[at + 1]
    return (sym[at].astype(np.uint64) << np.uint64(32)) | sym[at + 1]


def _find(pairs: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted ``pairs``, or their number: by a table over 18 hash bits, and by search where pairs share a slot."""

    def slots(x: np.ndarray) -> np.ndarray:
        return (x * x.dtype.type(0x9E3779B1)) >> x.dtype.type(14) & x.dtype.type((1 << 18) - 1)

    table = np.full(1 << 18, len(pairs), np.int32)
    table[slots(pairs)] = np.arange(len(pairs))
    which = table[slots(key)]
    wrong = np.flatnonzero(np.append(pairs, pairs[:1])[which] != key)
    wrong = wrong[which[wrong] < len(pairs)]
    near = np.minimum(np.searchsorted(pairs, key[wrong]), len(pairs) - 1)
    which[wrong] = np.where(pairs[near] == key[wrong], near, len(pairs))
    return which


def expand_some(symbols: np.ndarray, n_ids: int, rules: np.ndarray) -> np.ndarray:
    """Ids behind a few symbols, top down, so that other rules stay unexpanded."""
    symbols = symbols.astype(np.uint32)
    while (big := symbols >= n_ids).any():
        ends = np.cumsum(1 + big)
        out = np.repeat(symbols, 1 + big)
        part = rules[symbols[big] - n_ids]
        out[ends[big] - 2], out[ends[big] - 1] = part[:, 0], part[:, 1]
        symbols = out
    return symbols


class Grammar:
    """A shard's rules, expanded once; symbols of any range of documents decode by one gather."""

    def __init__(self, n_ids: int, rules: np.ndarray):
        self.flat = np.arange(n_ids, dtype=np.uint32)
        self.start, self.size = np.arange(n_ids), np.ones(n_ids, np.int64)
        done = 0
        while done < len(rules):
            # all further rules whose parts are known
            ready = done + int(np.argmax(np.append((rules[done:] >= len(self.size)).any(1), True)))
            part = rules[done:ready].reshape(-1).astype(np.int64)
            more = self.flat[ragged(self.start[part], self.size[part])]
            size = self.size[part].reshape(-1, 2).sum(1)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, more])
            done = ready

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.start[symbols], self.size[symbols])]


def _arrays(shard: dict) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols) of a shard row."""
    kind = f"<u{shard['width']}"
    return np.frombuffer(shard["rules"], kind).reshape(-1, 2), np.frombuffer(shard["symbols"], kind)


def read_tokens(shard: dict, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` of a shard row: the stored lengths find their symbols, and no other is expanded."""
    rules, symbols = _arrays(shard)
    lengths = np.concatenate([np.ones(shard["n_ids"], np.int64), np.frombuffer(shard["rule_lengths"], "<u4")])
    ends = np.cumsum(lengths[symbols])
    begin, end = max(begin, 0), min(end, int(ends[-1]) if len(ends) else 0)
    if begin >= end:
        return np.zeros(0, np.uint32)
    a, b = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end) + 1
    skipped = begin - int(ends[a - 1] if a else 0)
    return expand_some(symbols[a:b], shard["n_ids"], rules)[skipped : skipped + end - begin]


def read_document(shard: dict, k: int) -> np.ndarray:
    """Ids of the ``k``-th document of a shard row, without expanding the others."""
    at = int(np.sum(shard["doc_tokens"][:k], dtype=np.int64))
    return read_tokens(shard, at, at + shard["doc_tokens"][k])


@lru_cache(2)
def _library_encoder(path: str) -> tuple[Encoder, int]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()

    special = {t.content: i for i, t in lib.get_added_tokens_decoder().items()}
    plain = [t.content for t in lib.get_added_tokens_decoder().values() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]

    def words(cp: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text, ends = cp.tobytes().decode("utf-32-le"), np.cumsum(lens)
        each = [text[a:b] for a, b in zip(ends - lens, ends)]
        if not plain:
            out = [e.ids for e in lib.encode_batch_fast(each, add_special_tokens=False)]
            return np.fromiter((i for x in out for i in x), np.int32), np.fromiter(map(len, out), np.int64, len(out))
        # no word holds a special token, so one of them keeps the words of a call apart
        joined = [plain[0].join(each[k : k + JOINED_WORDS]) + plain[0] for k in range(0, len(each), JOINED_WORDS)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in lib.encode_batch_fast(joined, add_special_tokens=False)])
        cuts = np.flatnonzero(ids == special[plain[0]])
        return np.delete(ids, cuts), np.diff(cuts, prepend=-1) - 1

    return Encoder(special, words), lib.get_vocab_size()


def write_shards(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode and compress ``df`` into a shard table at ``path``, in ascending order of ``id_col``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, n_ids = _library_encoder(tokenizer)
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        docs: list = []
        sizes: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            counts = np.concatenate(sizes)
            rules, symbols = compress(np.concatenate(ids), counts, n_ids)
            width = 2 if n_ids + len(rules) <= NARROW else 4
            lengths = Grammar(n_ids, rules).size[n_ids:].astype("<u4")
            row = [part, shard, start, int(counts.sum()), docs, counts.tolist(), n_ids, width, rules.astype(f"<u{width}").tobytes(), lengths.tobytes(), symbols.astype(f"<u{width}").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch, texts in slices(batches, "text", 1_000_000):
            flat, at = encoder.encode(texts)
            counts = np.diff(at) + 1
            ids.append(np.insert(flat, at[1:], end_id))
            sizes.append(counts)
            docs += batch.column("id").to_pylist()
            held += int(counts.sum())
            if held >= shard_tokens:
                yield close()
                shard, start, held = shard + 1, start + held, 0
                ids, docs, sizes = [], [], []
        if held:
            yield close()

    rows.mapInArrow(run, SCHEMA).write.parquet(path)


def read_shards(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode a shard table: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary, unsigned 32-bit)."""
    table = spark.read.schema(SCHEMA).parquet(path)
    # one row for each part, as many as the writer had partitions
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                rules, symbols = _arrays({"width": row["width"].as_py(), "rules": row["rules"].as_buffer(), "symbols": row["symbols"].as_buffer()})
                flat = Grammar(row["n_ids"].as_py(), rules).expand(symbols).astype("<u4")
                counts = row["doc_tokens"].values.to_numpy().astype(np.int64)
                at = np.concatenate([[0], np.cumsum(counts)])
                raw = memoryview(flat).cast("B")
                start = row["base"].as_py() + row["start"].as_py()
                columns = [row["doc_ids"].values, pa.array(start + at[:-1]), pa.array(counts), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return table.join(F.broadcast(base), "part").drop("rule_lengths").mapInArrow(run, schema)
