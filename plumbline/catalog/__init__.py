"""Queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

import importlib

from plumbline.catalog.registry import IDS, ORACLES, QUERIES  # noqa: F401

MODULES = ["relational", "evaluation", "profiling", "splitting", "series", "baskets", "corpus", "segmentation", "modelling", "streams", "outliers", "clustering", "forecasting", "reports"]


def load() -> None:
    """Import the catalogue's modules; each registers its queries."""
    for name in MODULES:
        importlib.import_module(f"plumbline.catalog.{name}")
