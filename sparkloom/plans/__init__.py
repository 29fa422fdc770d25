"""Registered queries and the SQL that they are held against."""

from __future__ import annotations

from . import chunk_plans, label_plans, metric_plans, provenance_plans, retrieval_plans, source_plans, stat_plans, text_plans  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark, sf_dir):
    return QUERIES["retrieval_pipelines"](spark, sf_dir)
