"""Registered queries over the given tables, each with its SQL where SQL can express it."""

from privloom.plans import counting, metrics, models, profiling, risk  # noqa: F401
from privloom.plans.base import ORACLES, QUERIES  # noqa: F401
