"""Import every plan module so its queries register, then expose the registry."""

from __future__ import annotations

from tessera.plans import (auditing, cohorts, denoising, dosing, evaluation,  # noqa: F401
                           features_q, io, learning, panel, screening, similarity, splits)
from tessera.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
