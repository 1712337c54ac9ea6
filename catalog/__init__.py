"""Registered queries: each operator on the driver's tables, with the SQL that checks it."""

from __future__ import annotations

import importlib

FAMILIES = ("source", "ingest", "text", "match", "diff", "label", "stats", "sample", "stream", "model", "job")


def load():
    """All registered queries by name."""
    from catalog.registry import REGISTRY

    for family in FAMILIES:
        importlib.import_module(f"catalog.{family}_queries")
    return REGISTRY
