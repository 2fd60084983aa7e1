"""All registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_screening", "q_rules", "q_sources", "q_checks", "q_uploads")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"assayer.plans.{name}"), attribute).items():
            if key in merged:
                raise ValueError(f"query {key} is registered twice")
            merged[key] = value
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
