"""All queries of the library bound to the driver's tables, and their SQL.

A name begins with the inventory rows that the query exercises.
"""

from __future__ import annotations

from quillstone.plans import code, dataflow, feedback, indexes, navigation, retrieval, scalars, tree
from quillstone.plans.registry import QUERIES, SQL

FLAGSHIP = "r11_hybrid_search"

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "code", "dataflow", "feedback", "indexes", "navigation", "retrieval", "scalars", "tree"]
