"""All registered queries."""

from __future__ import annotations

from rolebook.plans import queries_joins  # noqa: F401
from rolebook.plans import queries_matching  # noqa: F401
from rolebook.plans import queries_postings  # noqa: F401
from rolebook.plans import queries_sources  # noqa: F401
from rolebook.plans import queries_state  # noqa: F401
from rolebook.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
