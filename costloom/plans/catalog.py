"""Imports every plan module so that its queries are registered."""

from costloom.plans import costing, extraction, layouts, matching, money, reporting, scalars, stores, streams  # noqa: F401
from costloom.plans.registry import ORACLES, QUERIES  # noqa: F401
