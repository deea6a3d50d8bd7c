"""All registered queries."""

from __future__ import annotations

import importlib

SUBJECTS = ["catalog", "telemetry", "dialogue", "layout", "story", "review", "audit", "streams"]


def registered() -> dict:
    found: dict = {}
    for subject in SUBJECTS:
        try:
            module = importlib.import_module(f"pagetrace.suite.{subject}")
        except ModuleNotFoundError as error:
            if error.name != f"pagetrace.suite.{subject}":
                raise
            continue
        for name, entry in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query registered twice: {name}")
            found[name] = entry
    return found
