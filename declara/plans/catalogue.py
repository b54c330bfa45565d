"""Imports every module that registers queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ["relational", "textual", "clustering", "scoring", "predicting", "forms", "learning", "streams", "questions"]


def load() -> None:
    for name in MODULES:
        import_module(f"declara.plans.{name}")
