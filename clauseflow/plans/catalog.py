"""All registered queries (importing a module registers its queries)."""

from clauseflow.plans import clusters, compliance, evidence, extraction, files_and_streams, learning, ordering, projections, relational, reports  # noqa: F401
from clauseflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
