"""All registered queries."""

from __future__ import annotations

from . import catalog_eval, catalog_gallery, catalog_misc, catalog_reports, catalog_scenes, catalog_verdicts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
