"""All registered queries."""

from turnscope.plans import (  # noqa: F401
    compare_queries,
    conversation_queries,
    format_queries,
    kpi_queries,
    record_queries,
    report_queries,
    stream_queries,
    usage_queries,
)
from turnscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
