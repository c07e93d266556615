"""All core queries and their SQL, for the driver."""

from __future__ import annotations

from quirework.plans import composed, marked, shelf  # noqa: F401  registers its queries
from quirework.plans.standard import ORACLES, QUERIES

FLAGSHIP = "review_items"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
