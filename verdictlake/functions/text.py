"""Word keys of short texts as column expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words that carry nothing, and suffixes with the length a word must exceed
STOPWORDS = "a an and are as at be but by for from has have if in is it its of on or that the this to was were will with you your".split()
SUFFIXES = (("ingly", 5), ("edly", 4), ("ing", 4), ("ies", 4), ("ied", 4), ("ed", 4), ("ly", 4), ("es", 4), ("s", 4))


_ENDS = "|".join(f"(?<=.{{{least + 1 - len(suffix)}}}){suffix}" for suffix, least in SUFFIXES)
#: one suffix off, then a final y after a consonant, a final e, a doubled final consonant
_STEPS = ((f"(?:{_ENDS})$", ""), ("(?<=..[^aeiou])y$", ""), ("(?<=...)e$", ""), (r"(?<=..)([^aeiou])\1$", r"\1"))


def stem(word: Column) -> Column:
    """Matching key of a word.

    Every step is one anchored pattern that names its input once, so the expression stays small."""
    for pattern, kept in _STEPS:
        word = F.regexp_replace(word, pattern, kept.replace("\\", "$"))
    return word


_CUTS = [(re.compile(p), kept) for p, kept in _STEPS]


def stemmed(word: str) -> str:
    """``stem`` of one word."""
    for pattern, kept in _CUTS:
        word = pattern.sub(kept, word, count=1)
    return word


#: stems of words that a worker has met
_STEMS: dict[str, str] = {}
MOST_STEMS = 250_000
#: bytes of text that are counted at a time; a longer text is a part of its own
PART_BYTES = 1 << 20


def text_parts(batch: pa.RecordBatch, text: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of text, so that what is made of a part doesn't depend on the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    at = 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (size or PART_BYTES), side="right")))
        yield batch.slice(at, until - at)
        at = until


def token_counts(df: DataFrame, text: str, keep: list[str], drop_stopwords: bool = True) -> DataFrame:
    """(keep, token, n): how often each stemmed token occurs in a row's text; null texts have none.

    A row's repeats are folded before anything is shuffled, and a worker stems a word once. In batches of Arrow this takes a
    tenth of the time of the same steps as column expressions, whose generated code is too large to be compiled. A worker holds
    the lists of one part of a batch and a bounded number of stems."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "token string, n long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = set(STOPWORDS) if drop_stopwords else set()
        find = re.compile("[a-z0-9]{2,}").findall
        for batch in (part for whole in batches for part in text_parts(whole, text)):
            if len(_STEMS) > MOST_STEMS:
                _STEMS.clear()
            row, tokens, counts = [], [], []
            for k, t in enumerate(batch.column(text)):
                t = t.as_py()
                if not t:
                    continue
                found: dict[str, int] = {}
                for word, times in Counter(find(t.lower())).items():
                    if word not in stop:
                        token = _STEMS.get(word)
                        if token is None:
                            token = _STEMS[word] = stemmed(word)
                        found[token] = found.get(token, 0) + times
                row += [k] * len(found)
                tokens += found
                counts += found.values()
            which = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(which) for c in keep), pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], [*keep, "token", "n"])

    return df.select(*keep, text).mapInArrow(run, schema)


def raw_tokens(text: Column, drop_stopwords: bool = True) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= 2) & (~w.isin(STOPWORDS) if drop_stopwords else F.lit(True)))


def estimated_tokens(text: Column) -> Column:
    """Token estimate of one segment."""
    return F.ceil(F.length(text) / 4) + 2
