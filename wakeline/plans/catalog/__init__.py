"""Every registered query with its reference SQL, grouped by topic."""

from __future__ import annotations

import importlib

from wakeline.plans.catalog.base import ORACLES, QUERIES

TOPICS = [
    "cleaning", "motion", "segments", "places", "weather", "ledgers", "grids", "neighbours", "drift", "decisions", "scorers", "lake", "streams", "evaluation",

]


def load() -> tuple[dict, dict]:
    for topic in TOPICS:
        importlib.import_module(f"wakeline.plans.catalog.{topic}")
    return QUERIES, ORACLES
