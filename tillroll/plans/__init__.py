"""Registered queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil

from tillroll.plans.registry import PLANS, Plan, plan, runner

__all__ = ["Plan", "load_plans", "plan", "runner"]


def load_plans() -> dict[str, Plan]:
    """Import every module of this package; each registers its queries."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return PLANS
