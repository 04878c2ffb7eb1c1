"""All registered queries."""

import importlib

from moteflow.catalog.registry import ORACLES, QUERIES

MODULES = ["drift", "pairs", "filters", "stats", "linking", "cleaning", "motion", "deformation", "imaging", "catalogue", "calibration", "exports"]
for _m in MODULES:
    importlib.import_module(f"moteflow.catalog.{_m}")
