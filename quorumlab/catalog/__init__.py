"""Registered queries and their oracle SQL, by family."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ["updates", "prep", "text", "metrics", "jobs", "loops"]


def load():
    """All registered queries and oracle texts."""
    for family in FAMILIES:
        import_module(f"quorumlab.catalog.{family}")
    from quorumlab.catalog.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
