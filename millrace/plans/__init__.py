"""Ready-made queries over the driver tables, one per operator."""

from . import columns, learning, quality, shaping  # noqa: F401  (registers the queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
