"""Every registered query and its SQL."""

from __future__ import annotations

from . import surface  # noqa: F401  registers its queries beside the others
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
