"""All registered queries."""

from martlens.testbed import (  # noqa: F401
    model_queries,
    quality_queries,
    report_queries,
    rollup_queries,
    storage_queries,
)
from martlens.testbed.registry import ORACLE, QUERIES  # noqa: F401
