"""A user's own model or tokenizer over a table: loaded once a worker, fed with batches of a budget, its answers checked."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .serving import answer_faults

BUDGET, MOST_ROWS = 4_194_304, 1024
#: what ``load`` of a plan has returned in this worker; a worker serves few plans, of which the last ones are kept
_LOADED: dict[str, Any] = {}


def _worker_copy(token: str, load: Callable[[], Any]) -> Any:
    if token not in _LOADED:
        while len(_LOADED) >= 4:
            del _LOADED[next(iter(_LOADED))]
        _LOADED[token] = load()
    return _LOADED[token]


def budget_cuts(lengths: Sequence[int], budget: int, most_rows: int = MOST_ROWS) -> list[tuple[int, int]]:
    """Consecutive parts whose rows times longest squared fit the budget, of one row at least and ``most_rows`` at most."""
    parts: list[tuple[int, int]] = []
    start = wide = 0
    for i, n in enumerate(lengths):
        n = max(int(n), 1)
        if i > start and ((i - start + 1) * max(wide, n) ** 2 > budget or i - start >= most_rows):
            parts.append((start, i))
            start, wide = i, 0
        wide = max(wide, n)
    if len(lengths):
        parts.append((start, len(lengths)))
    return parts


def score_with(questions: DataFrame, load: Callable[[], Callable[[pd.DataFrame], Sequence[Sequence[float]]]], length: str, n: str, logits: str = "logits", budget: int = BUDGET, most_rows: int = MOST_ROWS) -> DataFrame:
    """``questions`` with the logits that a user's scorer gives them and, in ``reasons``, what is wrong with an answer.

    ``load()`` runs once in each worker and returns the scorer, which gets rows in their order and returns one list of
    logits for each. Rows go to it in batches whose count times longest ``length`` squared is at most ``budget``, so padding
    to the longest is bounded; a longer row is a batch of its own. ``n`` is the number of labels a question has. An answer of
    another count, one that isn't finite and one that is missing are told, never repaired; another number of answers than
    rows is an error. Null lengths count as one."""
    token = uuid.uuid4().hex
    kind = T.StructType([*questions.schema.fields, T.StructField(logits, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _worker_copy(token, load)
        for batch in batches:
            for i, j in budget_cuts([x or 1 for x in batch.column(length).to_pylist()], budget, most_rows):
                part = batch.slice(i, j - i)
                answers = list(scorer(part.to_pandas()))
                if len(answers) != j - i:
                    raise ValueError(f"the scorer returned {len(answers)} answers to {j - i} questions")
                given = pa.array([None if a is None else np.asarray(a, float) for a in answers], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, given], kind.fieldNames())

    scored = questions.mapInArrow(run, kind)
    return scored.withColumn("reasons", answer_faults(F.col(logits), F.col(n)))


def exact_tokens(df: DataFrame, load: Callable[[], Callable[[list[str]], Sequence[int]]], segments: Column, out: str = "tokens") -> DataFrame:
    """``df`` with the tokens that a user's tokenizer counts in all of a row's ``segments`` (array of string; null segments count zero).

    ``load()`` runs once in each worker and returns a function from texts to their counts."""
    token = uuid.uuid4().hex
    staged = df.withColumn("_segments", segments)
    kind = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _worker_copy(token, load)
        for batch in batches:
            rows = batch.column("_segments").to_pylist()
            size = [len(r or []) for r in rows]
            texts = [t for r in rows for t in r or []]
            given = iter(count([t for t in texts if t is not None]))
            each = np.array([0 if t is None else next(given) for t in texts], np.int64)
            totals = np.concatenate([[0], np.cumsum(each)])
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(totals[ends] - totals[ends - size], pa.int64())], kind.fieldNames())

    return staged.mapInArrow(run, kind)
