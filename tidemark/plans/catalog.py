"""All registered queries."""

from __future__ import annotations

import importlib

from tidemark.plans.base import ORACLES, QUERIES

MODULES = ["positions", "features", "joins", "windowing", "metrics", "aggregates", "sources", "models", "streaming"]


def load():
    for m in MODULES:
        importlib.import_module(f"tidemark.plans.q_{m}")
    return QUERIES, ORACLES
