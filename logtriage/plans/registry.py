"""Collects the registered queries of every plan module."""

from __future__ import annotations


def all_queries() -> dict:
    from . import queries, queries_features, queries_metrics, queries_models
    return {**queries.QUERIES, **queries_metrics.QUERIES, **queries_features.QUERIES, **queries_models.QUERIES}
