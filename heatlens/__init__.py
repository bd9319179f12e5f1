"""Hot and cold records from access logs, on Spark."""

from heatlens.params import HeatParams
from heatlens.plans.classify import (
    classify_backward,
    classify_backward_bucketed,
    classify_backward_fixed,
    classify_by_block,
    classify_by_time,
    classify_forward,
    classify_neighbor,
    classify_total_by_block,
    classify_total_by_time,
    search_backward,
    search_backward_bucketed,
    search_backward_fixed,
)
from heatlens.sources.accesses import accesses_from
from heatlens.sources.trace import read_trace, trace_accesses, with_file_order
from heatlens.staging import drop_staged

__all__ = [
    "HeatParams",
    "accesses_from",
    "classify_backward",
    "classify_backward_bucketed",
    "classify_backward_fixed",
    "classify_by_block",
    "classify_by_time",
    "classify_forward",
    "classify_neighbor",
    "classify_total_by_block",
    "classify_total_by_time",
    "drop_staged",
    "read_trace",
    "search_backward",
    "search_backward_bucketed",
    "search_backward_fixed",
    "trace_accesses",
    "with_file_order",
]
