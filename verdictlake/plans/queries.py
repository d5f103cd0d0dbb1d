"""All registered queries: importing a module of queries registers them."""

from . import case_queries, catalog, outcome_queries, scoring_queries, serving_queries, teacher_queries, variant_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
