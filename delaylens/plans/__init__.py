"""Named queries. Importing this package fills the registry."""

from delaylens.plans import (  # noqa: F401
    flight_queries,
    metric_queries,
    model_queries,
    source_queries,
    transit_queries,
    travel_queries,
)
from delaylens.plans.registry import REGISTRY, run

__all__ = ["REGISTRY", "run"]
