"""The queries of the engine's own operators, by module."""

from __future__ import annotations

import importlib
import os
import sys
from pathlib import Path

MODULES = ["basics", "statistics", "search", "extraction", "capture", "reads", "upkeep", "path", "packets", "modes", "skills", "surface"]


def load():
    """The registry with every module's queries in it."""
    root = str(Path(__file__).resolve().parents[2])
    for path in (sys.path, paths := os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        if root not in path:
            path.insert(0, root)
    os.environ["PYTHONPATH"] = os.pathsep.join(p for p in paths if p)  # for Python workers started later
    for name in MODULES:
        importlib.import_module(f"mnemo.plans.{name}")
    return importlib.import_module("mnemo.plans.registry")
