"""Queries of the training-data operators, for the driver's entry module."""

from __future__ import annotations

from importlib import import_module

MODULES = ["toxicity", "language", "stats", "similar", "pii", "pairs", "packing", "mixing", "residue"]


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        try:
            module = import_module(f"millrace.llm.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"millrace.llm.{name}":
                raise
            continue
        out.update(module.QUERIES)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for name in MODULES:
        try:
            module = import_module(f"millrace.llm.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"millrace.llm.{name}":
                raise
            continue
        out.update(getattr(module, "ORACLES", {}))
    return out
