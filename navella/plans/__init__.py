"""Registered queries; importing a module of this package registers its own."""

from navella.plans import documents, funds, loading, queries  # noqa: F401
from navella.plans.registry import ORACLES, QUERIES  # noqa: F401
