"""
plus, where SQL can express it, the equivalent DuckDB SQL over the driver tables.

Queries read whole driver tables (through the panel views of
``sources.tables``); nothing is capped, sampled or filtered to keep checks cheap.
"""

from __future__ import annotations

from . import q_builder, q_eval, q_faulty, q_io, q_models, q_prep, q_profile, q_publish, q_reports, q_stages  # noqa: F401  (registration)
from .registry import ORACLE, QUERIES  # noqa: F401
