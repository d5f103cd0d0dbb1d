"""Registry of the library's queries, and pieces of SQL that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, SUFFIXES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---- SQL pieces -----------------------------------------------------------------------------


def u_sql(text: str) -> str:
    return f"(('0x' || substr(sha256({text}), 1, 8))::UBIGINT / 4294967296.0)"


def draw_sql(salt: str, key: str) -> str:
    return u_sql(f"'{salt}|' || CAST({key} AS VARCHAR)")


def scored_sql(name: str = "sc", salt: str = "l", lift: float = 1.2) -> str:
    return f"""
    {name}_t AS (SELECT list_sort(list(DISTINCT event_type)) AS ty FROM events),
    {name}_l AS (SELECT event_id AS case_id, CAST(user_id % 7 AS VARCHAR) AS domain, user_id, ts, list_position(ty, event_type) - 1 AS y,
      list_transform(range(len(ty)), lambda i: 3 * {u_sql(f"'{salt}' || CAST(i AS VARCHAR) || '|' || CAST(event_id AS VARCHAR)")} + CASE WHEN i = list_position(ty, event_type) - 1 THEN {lift} ELSE 0 END) AS logits FROM events, {name}_t),
    {name}_e AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM {name}_l),
    {name}_p AS (SELECT *, list_transform(ex, lambda x: x / list_sum(ex)) AS probs FROM {name}_e),
    {name} AS (SELECT *, round(list_max(probs), 9) AS conf, CASE WHEN list_position(probs, list_max(probs)) - 1 = y THEN 1.0 ELSE 0.0 END AS correct,
      -ln(greatest(probs[y + 1], 1e-12)) AS nll, list_sum(list_transform(range(len(probs)), lambda i: pow(probs[i + 1] - CASE WHEN i = y THEN 1 ELSE 0 END, 2))) AS brier,
      CAST(least(floor(round(list_max(probs), 9) / (1.0::DOUBLE / 15)), 14) AS INTEGER) AS bin FROM {name}_p)"""


def _stem(w: str) -> str:
    cut = w
    for suffix, least in reversed(SUFFIXES):
        cut = f"CASE WHEN length({w}) > {least} AND {w} LIKE '%{suffix}' THEN left({w}, length({w}) - {len(suffix)}) ELSE {cut} END"
    return cut


def tokens_sql(name: str, source: str, key: str) -> str:
    """CTEs from (key, text) to (key, token)."""
    stops = ", ".join(f"'{w}'" for w in STOPWORDS)
    v = "('a', 'e', 'i', 'o', 'u')"
    return f"""
    {name}_w AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {source}),
    {name}_1 AS (SELECT {key}, {_stem('w')} AS w FROM {name}_w WHERE length(w) >= 2 AND w NOT IN ({stops})),
    {name}_2 AS (SELECT {key}, CASE WHEN length(w) > 3 AND w LIKE '%y' AND substr(w, length(w) - 1, 1) NOT IN {v} THEN left(w, length(w) - 1) ELSE w END AS w FROM {name}_1),
    {name}_3 AS (SELECT {key}, CASE WHEN length(w) > 3 AND w LIKE '%e' THEN left(w, length(w) - 1) ELSE w END AS w FROM {name}_2),
    {name} AS (SELECT {key}, CASE WHEN length(w) > 3 AND right(w, 1) = substr(w, length(w) - 1, 1) AND right(w, 1) NOT IN {v} THEN left(w, length(w) - 1) ELSE w END AS token FROM {name}_3)"""
