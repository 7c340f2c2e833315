"""Every registered query with the SQL it must agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = ["tracks", "grains", "features", "stats", "life", "votes", "models"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"{__name__}.{name}"), attribute))
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
