"""All registered queries."""

from auditframe.plans import contracts, ledger, results  # noqa: F401
from auditframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
