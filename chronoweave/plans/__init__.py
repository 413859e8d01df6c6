"""Named queries: each module registers its own."""

from __future__ import annotations

import importlib

from chronoweave.plans.registry import REGISTRY, Registry

MODULES = ("general_problems", "graph_queries", "domain_queries", "link_queries", "panel_queries", "text_queries", "model_queries")


def load() -> Registry:
    for name in MODULES:
        importlib.import_module(f"chronoweave.plans.{name}")
    return REGISTRY
