"""All registered queries."""

from captura.plans import (  # noqa: F401
    catalog_evaluation,
    catalog_files,
    catalog_geometry,
    catalog_scores,
    catalog_sets,
    catalog_systems,
    catalog_text,
    catalog_tracking,
)
from captura.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
