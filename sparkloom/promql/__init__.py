"""PromQL compiled to DataFrames: ``query_range`` and ``query``."""

from sparkloom.promql.compile import query, query_range, shown

__all__ = ["query", "query_range", "shown"]
