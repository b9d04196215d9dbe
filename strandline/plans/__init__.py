"""Queries on the given tables, each with the SQL it must agree with."""

from strandline.plans import (
    cnv_queries,
    coverage_queries,
    fusion_queries,
    interval_queries,
    methylation_queries,
    qc_queries,
    score_queries,
    source_queries,
    stream_queries,
    variant_queries,
)
from strandline.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
