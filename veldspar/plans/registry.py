"""Queries and SQL of the analytics operators."""

from __future__ import annotations

from . import composition, evaluation, loop, relational, scalars, screening, spectra, statistics, storage, texts, vectors, views  # noqa: F401
from .core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
