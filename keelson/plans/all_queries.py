"""All registered queries of the audit part."""

from keelson.plans import queries_audit, queries_listing, queries_progress  # noqa: F401
from keelson.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
