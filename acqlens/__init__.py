"""acqlens - full-funnel marketing analytics as Spark DataFrame operators.

Inputs are six tables (channels, campaigns, daily campaign spend, leads,
customers, orders) held in a ``Model``; every operator is a function
``op(model, ...) -> DataFrame`` built from Catalyst expressions.
"""

from .sources.model import Model, TABLES  # noqa: F401

__all__ = ["Model", "TABLES"]
