"""Registered queries over the shared tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sources", "integration", "cleaning", "preprocessing", "features", "datasets", "holdout",
           "models", "neighbors", "compositions")


def collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"checks.{name}"), attribute)
        clash = set(out) & set(part)
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(part)
    return out
