"""All registered queries and oracles."""

from logloom.plans import catalog_alerts, catalog_ingest, catalog_ops, catalog_search  # noqa: F401
from logloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
