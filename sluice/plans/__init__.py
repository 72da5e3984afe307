"""Registered queries over the driver tables (one module per input table)."""

from __future__ import annotations

import importlib

MODULES = (
    "q_documents",
    "q_conversations",
    "q_events",
    "q_embeddings",
    "q_policy",
    "q_ops",
    "q_check",
    "q_streaming",
)


def all_queries():
    """Import every query module; return (name -> fn, name -> SQL)."""
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    from .registry import ORACLE, QUERIES

    return QUERIES, ORACLE
