"""All runnable queries, one per operator, with SQL twins where SQL can say it."""

from tidegrid.catalogue.registry import ORACLES, QUERIES
from tidegrid.catalogue import (aggregates, basics, calendar, diagnostics, evaluation, features,  # noqa: F401
                                forecasts, joins, sources, windows)

__all__ = ["ORACLES", "QUERIES"]
