"""Training-data operators: filters, deduplication, scans, tokens and packing.

Nothing outside this subpackage imports it.  ``QUERIES`` and ``ORACLES`` hold
what the driver runs: one ``opN_<name>`` query per operator.
"""

from quirework.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
