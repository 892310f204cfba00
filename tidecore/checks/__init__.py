"""Registered queries over the driver's tables, each with an independent SQL oracle."""

from __future__ import annotations

from importlib import import_module

AREAS = ("graph_checks", "bin_checks", "core_checks", "maintain_checks", "profile_checks", "stream_checks")


def _base():
    for area in AREAS:
        import_module(f"tidecore.checks.{area}")
    return import_module("tidecore.checks.base")


def queries() -> dict:
    return dict(_base().QUERIES)


def oracles() -> dict:
    return dict(_base().ORACLES)
