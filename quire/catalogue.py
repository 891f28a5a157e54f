"""All queries of the library's own operators and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("paths", "text", "classification", "ingest", "navigation", "planning", "linking", "documents", "tables_notes", "ocr", "reporting", "validation", "manifests")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents", "conversations")


class Tables:
    """The tables of a folder, by name or by SQL over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = {name: self[name] for name in TABLES if name in text}
        for name, df in used.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text)


def query(name: str, oracle: str | None = None):
    """Register a function of :class:`Tables` as a query."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"quire.queries.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)
