"""All registered queries; importing the modules fills the registry."""
from __future__ import annotations

from siliscope.plans import feature_queries, map_queries, model_queries, region_queries, review_queries, scoring_queries, search_queries, source_queries  # noqa: F401
from siliscope.plans import registry


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return registry.oracles()
