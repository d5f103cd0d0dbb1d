"""Word spans, highlights and explanation scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_parts


#: Bytes of text whose equal words are put together, and rows of them that are handed on at once.
TOGETHER_BYTES, TOGETHER_ROWS = 16 << 20, 1 << 17


def word_spans(df: DataFrame, text: str, keep: list[str], together: bool = False) -> DataFrame:
    """(keep, w, start, end, word, gap, head): runs of non-white-space with code-point offsets, end exclusive,
    the white space behind each and, with a text's first word, the white space before it.

    Words are found in the bytes of a part of a batch at once, each row on its own; nothing is shuffled. ``together`` is for words
    that are written out: rows of equal words follow each other within about ``TOGETHER_BYTES`` of text. Digests of words are too
    many for a dictionary of Parquet, but one that follows itself is stored in a few bytes."""
    kinds = dict(df.dtypes)
    names = [*keep, "w", "start", "end", "word", "gap", "head"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "w int, start long, end long, word string, gap string, head string"])

    def spans(part: pa.RecordBatch) -> pa.RecordBatch:
        row, columns = _placed(part.column(text))
        return pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in keep), *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if together:
                for part in text_parts(batch, text, TOGETHER_BYTES):
                    yield from _by_word(pa.concat_batches([spans(p) for p in text_parts(part, text)]))
            else:
                yield from map(spans, text_parts(batch, text))

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _by_word(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows with those of equal words one after another, each word where it comes first, its rows in order."""
    order = np.argsort(rows.column("word").dictionary_encode().indices.to_numpy(), kind="stable")
    for at in range(0, len(order), TOGETHER_ROWS):
        yield rows.take(pa.array(order[at : at + TOGETHER_ROWS]))


def _placed(texts: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """The row of each word of ``texts``, and its columns."""
    joined = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, values = joined.buffers()
    off = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(values, np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    edge[1:-1] |= space[1:] != space[:-1]
    # both ends of the runs that are no white space; a text's end parts its last run from the next text's first
    at = np.flatnonzero(edge)
    a, b = at[:-1], at[1:]
    starts, ends = a[~space[a]], b[~space[a]]
    row = np.searchsorted(off, starts, side="right") - 1
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    count = np.arange(len(row))
    w = count - np.maximum.accumulate(np.where(first, count, 0))
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    # the gap goes to the next word of the text, or to its end
    until = off[row + 1].copy()
    until[:-1] = np.where(first[1:], until[:-1], starts[1:])

    def cut(left: np.ndarray, right: np.ndarray) -> pa.Array:
        """Strings from left to right; both rise together, so every second piece between them is one."""
        bounds = np.empty(2 * len(left) + 1, np.int64)
        bounds[:-1:2], bounds[1:-1:2], bounds[-1] = left, right, right[-1] if len(right) else 0
        pieces = pa.Array.from_buffers(pa.large_string(), 2 * len(left), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        return pieces.take(pa.array(2 * count)).cast(pa.string())

    base = chars[off[row]]
    columns = [pa.array(w, pa.int32()), pa.array(chars[starts] - base, pa.int64()), pa.array(chars[ends] - base, pa.int64())]
    return pa.array(row, pa.int64()), [*columns, cut(starts, ends), cut(ends, until), cut(np.where(first, off[row], starts), starts)]


def span_overlap(words: DataFrame, spans: DataFrame, key: list[str], out: str = "marked") -> DataFrame:
    """``words`` (key, start, end) with ``out``: whether a span (key, start, end) touches the word, that is starts before its end and ends behind its start.

    Words and spans of a text go through one sort: of the spans that start before a word's end, the farthest end decides. So a
    text costs the sum of its words and spans, not their product."""
    at = words.withColumns({"_pos": F.col("end").cast("long"), "_kind": F.lit(0), "_end": F.lit(None).cast("long")})
    marks = spans.select(*key, F.col("start").cast("long").alias("_pos"), F.lit(1).alias("_kind"), F.col("end").cast("long").alias("_end"))
    before = Window.partitionBy(*key).orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    swept = at.unionByName(marks, allowMissingColumns=True).withColumn(out, F.coalesce(F.max("_end").over(before) > F.col("start"), F.lit(False)))
    return swept.where("_kind = 0").select(*words.columns, out)


def highlighted(words: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """``words`` with marked: whether a span (start, end) touches the word."""
    return span_overlap(words, spans, key)


def token_labels(tokens: DataFrame, spans: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Tokens (key, start, end, and their text's ``text``) with label: 1 where a gold span touches the token without its leading white space.

    A token of white space alone has label 0."""
    piece = F.substring(F.col(text), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    lead = F.length(F.regexp_extract(piece, r"^\s*", 0))
    bare = tokens.withColumns({"_start": F.col("start"), "start": F.col("start") + lead})
    marked = span_overlap(bare, spans, key, "_hit")
    label = (F.col("_hit") & (F.col("start") < F.col("end"))).cast("int")
    return marked.withColumn("label", label).withColumn("start", F.col("_start")).select(*tokens.columns, "label")


BUCKET = 64


def touching(words: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """(key, w, spans' other columns): each word with each span that touches it, met by buckets of ``BUCKET`` positions that both reach into."""
    bucket = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / BUCKET)))
    left = words.select(*key, "w", "start", "end").withColumn("_b", bucket("start", "end"))
    right = spans.withColumnsRenamed({"start": "_s", "end": "_e"}).withColumn("_b", bucket("_s", "_e"))
    met = left.join(right, [*key, "_b"]).where((F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e")))
    # a pair that shares several buckets counts in the first of them
    return met.where(F.col("_b") == F.greatest(F.floor(F.col("start") / BUCKET), F.floor(F.col("_s") / BUCKET))).drop("_b", "_s", "_e", "start", "end")


def token_prf(words: DataFrame, key: list[str], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Precision, recall and F1 of each case's word marks; zero where undefined."""
    n = words.groupBy(*key).agg(F.count_if(F.col(gold) & F.col(predicted)).alias("both"), F.count_if(F.col(gold)).alias("g"), F.count_if(F.col(predicted)).alias("p"))
    zero = F.lit(0.0)
    out = n.select(*key, F.coalesce(F.try_divide("both", "p"), zero).alias("precision"), F.coalesce(F.try_divide("both", "g"), zero).alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))


def mark_runs(words: DataFrame, key: list[str], mark: str) -> DataFrame:
    """(key, first, last): maximal runs of marked words."""
    on = words.where(F.col(mark)).withColumn("_g", F.col("w") - F.row_number().over(Window.partitionBy(*key).orderBy("w")))
    return on.groupBy(*key, "_g").agg(F.min("w").alias("first"), F.max("w").alias("last")).drop("_g")


def iou_f1(words: DataFrame, key: list[str], gold: str = "gold", predicted: str = "predicted", at_least: float = 0.5) -> DataFrame:
    """F1 over runs of marked words, matched at an overlap over union of ``at_least`` (above zero).

    Two runs overlap in words that carry both marks, so pairs are counted from the words and no run meets another that it doesn't touch."""
    rows = words.select(*key, "w", F.col(gold).alias("g"), F.col(predicted).alias("p"))
    for m in "gp":
        number = F.col("w") - F.row_number().over(Window.partitionBy(*key, m).orderBy("w"))
        rows = rows.withColumn(f"_{m}", F.when(F.col(m), number))
        rows = rows.withColumn(f"_n{m}", F.count(F.lit(1)).over(Window.partitionBy(*key, m, f"_{m}")))
    pairs = rows.where(F.col("g") & F.col("p")).groupBy(*key, "_g", "_p").agg(F.count(F.lit(1)).alias("_o"), F.first("_ng").alias("_ng"), F.first("_np").alias("_np"))
    met = pairs.where(F.col("_o") / (F.col("_ng") + F.col("_np") - F.col("_o")) >= at_least)
    hits = met.groupBy(*key).agg(F.count_distinct("_g").alias("gh"), F.count_distinct("_p").alias("ph"))
    sizes = rows.groupBy(*key).agg(F.count_distinct("_g").alias("_cg"), F.count_distinct("_p").alias("_cp")).where("_cg + _cp > 0")
    r, q = (F.coalesce(F.try_divide(F.coalesce(F.col(h), F.lit(0)), F.col(n)), F.lit(0.0)) for h, n in (("gh", "_cg"), ("ph", "_cp")))
    return sizes.join(hits, key, "left").select(*key, F.coalesce(F.try_divide(2 * r * q, r + q), F.lit(0.0)).alias("iou_f1"))


def merge_spans(tokens: DataFrame, key: list[str], text: str = "text", threshold: float = 0.5, ink: str | None = None) -> DataFrame:
    """Scored tokens (start, end, score) to spans: those over the threshold, merged where only white space parts them.

    A token opens a new span when the text between the running end and its start isn't blank, that is when the last character
    before it that isn't white space lies behind the running end. ``ink`` names a column with the end of that character; without
    it the column is made of ``text`` first, so that no text goes through the sort."""
    on = tokens.where(F.col("score") >= threshold)
    before = F.regexp_replace(F.substring(F.col(text), F.lit(1), F.col("start").cast("int")), r"\s+\z", "")
    on = on.select(*key, "start", "end", "score", (F.col(ink) if ink else F.length(before)).alias("_ink"))
    order = Window.partitionBy(*key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = on.withColumn("_r", reach).withColumn("_n", F.when(F.col("_r").isNull() | (F.col("_ink") > F.col("_r")), 1).otherwise(0))
    grouped = fresh.withColumn("_g", F.sum("_n").over(order))
    return grouped.groupBy(*key, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.least(F.lit(1.0), F.max("score")).alias("score")).drop("_g")


def bare_word(word: str) -> Column:
    """A word in lower case without what is neither letter nor number."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]", "")


def fit_lexicon(words: DataFrame, word: str, mark: str, least: int = 3, rate: float = 0.5) -> DataFrame:
    """(token, n, rate) of the words that are marked often enough."""
    return words.groupBy(bare_word(word).alias("token")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(mark).cast("double")).alias("rate")).where((F.col("n") >= least) & (F.col("rate") >= rate) & (F.col("token") != ""))


def paired_ci(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    both = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), key)
    d = F.col("_a") - F.col("_b")
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), (1.96 * F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))).alias("half_width"))
