"""All queries over the driver's tables."""

from attestor.plans import contracts, evidence, metric_queries, policies, rules_joins, scalars, streams  # noqa: F401
from attestor.plans.registry import ORACLES, QUERIES

FLAGSHIP = "oracle_vs_static"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
