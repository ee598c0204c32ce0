"""Pluggable stages: functions from data frame to data frame, by kind and name."""

from __future__ import annotations

import importlib
import pkgutil
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

KINDS = ("ingest", "index", "query")
Stage = Callable[..., DataFrame]


@dataclass(frozen=True)
class Entry:
    kind: str
    name: str
    description: str
    stage: Stage


_entries: dict[tuple[str, str], Entry] = {}


def stage(kind: str, name: str, description: str = "") -> Callable[[Stage], Stage]:
    """Registers a function as a stage; a later one of the same name takes its place."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")

    def add(function: Stage) -> Stage:
        _entries[kind, name] = Entry(kind, name, description, function)
        return function

    return add


def discover(package: str) -> list[str]:
    """Imports the modules of a package whose names have no leading underscore; broken ones are warned of and left out."""
    loaded = []
    for module in pkgutil.iter_modules(importlib.import_module(package).__path__):
        if not module.name.startswith("_"):
            try:
                importlib.import_module(f"{package}.{module.name}")
                loaded.append(module.name)
            except Exception as failure:
                warnings.warn(f"{package}.{module.name}: {failure}", stacklevel=2)
    return loaded


def stages(kind: str | None = None) -> list[Entry]:
    return [e for e in _entries.values() if kind in (None, e.kind)]


def load(kind: str, name: str) -> Stage:
    return _entries[kind, name].stage
