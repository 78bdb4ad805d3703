"""Registered queries: a builder over the stand-in tables and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tillroll.plans.tables import SQL_VIEWS, Tables


class Plan(NamedTuple):
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    def keep(fn):
        if name in PLANS:
            raise ValueError(f"duplicate query {name}")
        PLANS[name] = Plan(name, fn, with_views(sql) if sql else None)
        return fn
    return keep


def with_views(sql: str) -> str:
    """Prefix the stand-in views that ``sql`` names as common table expressions."""
    body = sql.strip()
    used: list[str] = []

    def need(text: str) -> None:
        for name, view in SQL_VIEWS.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                need(view)
                if name not in used:
                    used.append(name)

    need(body)
    if not used:
        return body
    head = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in used)
    rest = re.match(r"(?is)with\s+(.*)", body)
    return f"WITH {head},\n{rest.group(1)}" if rest else f"WITH {head}\n{body}"


def runner(p: Plan) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return p.build(Tables(spark, sf_dir))
    run.__name__ = p.name
    return run
