"""Query catalogue: a key, a Spark plan and, where SQL can say it, a DuckDB check."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelweave.plans.recipes import RECIPES, duck_text, spark_text

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """The given parquet tables of one folder and the tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._seen: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in TABLES:
                self._seen[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = spark_text(name)
                sources = {n: self(n) for n in named_in(text, [*TABLES, *RECIPES])}
                for source, df in sources.items():
                    df.createOrReplaceTempView(source)
                self._seen[name] = self.spark.sql(text)
        return self._seen[name]


def named_in(text: str, names) -> list[str]:
    words = set(re.findall(r"[A-Za-z_0-9]+", text))
    return [n for n in names if n in words]


def with_recipes(sql: str) -> str:
    """Prefix ``sql`` with the recipes it names, and the ones those name."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in named_in(text, RECIPES):
            if name not in wanted:
                visit(duck_text(name).replace(name, ""))
                wanted.append(name)

    visit(sql)
    parts = [f"{name} AS ({duck_text(name)})" for name in wanted]
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        body = re.sub(r"(?i)^with\s+recursive\b", "", body)
        return "WITH RECURSIVE " + ", ".join([*parts, body]) if parts else "WITH RECURSIVE " + body
    if re.match(r"(?i)with\b", body):
        body = re.sub(r"(?i)^with\b", "", body)
        return "WITH " + ", ".join([*parts, body]) if parts else "WITH " + body
    return "WITH " + ", ".join(parts) + " " + body if parts else body


PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a plan under ``key``; ``sql`` may name recipes as if they were tables."""

    def add(fn: Callable[[Tables], DataFrame]):
        if key in PLANS:
            raise KeyError(f"query {key} registered twice")
        PLANS[key] = fn
        if sql is not None:
            CHECKS[key] = with_recipes(sql)
        return fn

    return add
