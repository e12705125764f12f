"""The registered queries of this library and their SQL."""

from podium.plans import aggregate_queries, clean_queries, evaluate_queries, model_queries, series_queries, source_queries, stream_queries  # noqa: F401
from podium.plans.registry import ORACLES, QUERIES  # noqa: F401
