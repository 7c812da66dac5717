"""Queries of the notice engine, by name, and the same in SQL."""

from noticeloom.plans import board_queries, detail_queries, evaluation_queries, feed_queries, list_queries, merge_queries, operator_queries, reading_queries, record_queries, region_queries, result_queries, roster_queries, temporal_queries, text_queries, validity_queries, view_queries  # noqa: F401
from noticeloom.plans.registry import ORACLES, QUERIES  # noqa: F401
