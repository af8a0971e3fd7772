"""All registered queries outside the training-data operators."""

from gridlake.plans import book_catalog, functions_catalog, graph_catalog, model_catalog, sheet_catalog  # noqa: F401
from gridlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
