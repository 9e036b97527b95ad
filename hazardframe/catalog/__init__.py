"""Registered queries by subject."""

from hazardframe.catalog import calibration, clinical, missing_keys, models, runs, samples, statistics  # noqa: F401
from hazardframe.catalog.registry import ORACLES, QUERIES, runnable  # noqa: F401
