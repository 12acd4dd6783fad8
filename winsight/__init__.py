"""winsight: windowed data-quality checks on Spark (batch and Structured Streaming)."""

from .functions.durations import WindowSpec, duration_ms
from .operators import measures
from .operators.suite import Suite, union_results, window_result
from .plans.aggregate import windowed_measures

__all__ = ["WindowSpec", "duration_ms", "measures", "Suite", "union_results", "window_result",
           "windowed_measures"]
