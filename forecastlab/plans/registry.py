"""All queries of the library by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import decisions, features, models, prices, scalars, scoring, selection  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "a5_scorecard"
