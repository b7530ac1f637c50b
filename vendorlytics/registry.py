"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlytics.sources.oracle_views import with_views
from vendorlytics.sources.tables import FixtureTables

# (plan module, oracle module) pairs; each plan module defines QUERIES and
# each oracle module ORACLES.
MODULES = [
    ("vendorlytics.plans.kpis", "vendorlytics.plans.oracle_kpis"),
    ("vendorlytics.plans.reads", "vendorlytics.plans.oracle_reads"),
    ("vendorlytics.plans.repair", "vendorlytics.plans.oracle_repair"),
    ("vendorlytics.plans.changes_sales", "vendorlytics.plans.oracle_changes_sales"),
    ("vendorlytics.plans.changes_inventory", "vendorlytics.plans.oracle_changes_inventory"),
    ("vendorlytics.plans.changes_accounts", "vendorlytics.plans.oracle_changes_accounts"),
    ("vendorlytics.plans.new_tables", "vendorlytics.plans.oracle_new_tables"),
    ("vendorlytics.plans.billing", "vendorlytics.plans.oracle_billing"),
    ("vendorlytics.streaming.billing_stream", "vendorlytics.streaming.oracle_stream"),
]


# Test values of the registered queries; the plans' defaults are the
# reference's values, which the command line uses.
TEST_ARGS = {
    "sales_history_page": {"page": 2},
    "catalog_search": {"search": "old-1", "orden_precio": "desc", "precio_min": 100.0, "page": 2},
    "client_admission": {"quota": 10},
    "rate_limit_violations": {"limit": 1},
    "rate_limit_stream": {"limit": 1},
}


def _load():
    queries, oracles = {}, {}
    for plan, oracle in MODULES:
        queries.update(importlib.import_module(plan).QUERIES)
        oracles.update(importlib.import_module(oracle).ORACLES)
    return queries, oracles


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for engine-neutral comparison."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
                       for f in df.schema.fields])


def queries():
    q, _ = _load()

    def bind(fn, args):
        return lambda spark, sf_dir: flat(fn(FixtureTables(spark, sf_dir), **args))

    return {name: bind(fn, TEST_ARGS.get(name, {})) for name, fn in q.items()}


def oracle_sql():
    q, o = _load()
    return {name: with_views(sql) for name, sql in o.items() if name in q}
