"""All registered queries. Importing the modules fills the registry."""

from weekloom.plans import (  # noqa: F401
    queries_city,
    queries_features,
    queries_io,
    queries_models,
    queries_policy,
    queries_rollup,
)
from weekloom.plans.tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
