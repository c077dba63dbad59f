"""Runnable queries by family; importing a module registers its queries."""

from __future__ import annotations

import importlib

from papyra.plans.registry import REGISTRY, Query

FAMILIES = ["curation", "files", "textual", "modeling", "retrieval", "scoring", "dialogs", "timeseries", "streamjobs"]


def load_all() -> dict[str, Query]:
    for family in FAMILIES:
        importlib.import_module(f"papyra.plans.{family}")
    return REGISTRY
