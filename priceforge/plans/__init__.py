"""Registered queries, the table projections they read and their SQL checks."""

from priceforge.plans import files, history, listings, modelling, preparation  # noqa: F401
from priceforge.plans.registry import CHECKS, QUERIES  # noqa: F401
