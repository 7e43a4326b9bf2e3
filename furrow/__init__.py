"""Batch planning of localized field treatment, and the cleaning of large text corpora, as lazy PySpark plans."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from furrow.config import METHODS, PlanConfig, method_name

__all__ = ["METHODS", "PlanConfig", "generate", "method_name", "ship"]


def generate(weeds, obstacles, fields, cfg: PlanConfig):
    """Treatment polygons of all fields; see furrow.plans.treatment.generate."""
    from furrow.plans import treatment

    return treatment.generate(weeds, obstacles, fields, cfg)


def ship(spark) -> None:
    """Send this package to the session's Python workers, for clusters where it is not installed."""
    top = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="furrow-"), "furrow.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted([*top.rglob("*.py"), *top.rglob("*.java")]):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
