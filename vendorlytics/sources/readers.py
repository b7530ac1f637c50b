"""Application tables from any Spark reader (S1): files and JDBC alike.

A table is a ``TableSource``: reader format, options, optional schema, and a
mapping of application columns to those of the source. Files are read with
the given schema (no pass to infer one). JDBC reads are split by the reader's
partition options; these are checked before the database is asked, since the
reader would otherwise load a whole table through one task. What is read is
checked against the schema: a missing column or one of another type raises.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from vendorlytics.sources.tables import SnapshotTables

PARTITION_OPTIONS = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


@dataclass(frozen=True)
class TableSource:
    format: str = "parquet"
    options: dict = field(default_factory=dict)
    path: str | None = None
    schema: StructType | None = None
    columns: dict = field(default_factory=dict)  # application column -> source column


def check_jdbc(options: dict) -> None:
    """What the JDBC reader needs to read a table in parts."""
    given = {k.lower(): v for k, v in options.items()}
    if "url" not in given:
        raise ValueError("JDBC source without url")
    if ("dbtable" in given) == ("query" in given):
        raise ValueError("JDBC source needs either dbtable or query")
    parts = [o for o in PARTITION_OPTIONS if o.lower() in given]
    if parts and len(parts) < len(PARTITION_OPTIONS):
        raise ValueError(f"JDBC source in parts needs {', '.join(PARTITION_OPTIONS)}; given: {', '.join(parts)}")
    if parts and "query" in given:
        raise ValueError("JDBC source in parts needs dbtable, not query")
    if parts and int(given["numpartitions"]) < 1:
        raise ValueError("numPartitions must be 1 or more")


def _nested(f: StructField) -> bool:
    return isinstance(f.dataType, (ArrayType, MapType, StructType))


def read_table(spark: SparkSession, source: TableSource) -> DataFrame:
    """The table under its application column names."""
    options = dict(source.options)
    named = {f.name: source.columns.get(f.name, f.name) for f in source.schema} if source.schema else {}
    reader = spark.read.format(source.format)
    if source.format == "jdbc":
        check_jdbc(options)
    elif source.schema:
        # text files hold nested values as JSON
        text = source.format == "csv"
        reader = reader.schema(StructType([StructField(named[f.name], StringType() if text and _nested(f) else f.dataType)
                                           for f in source.schema]))
    if source.format == "csv":
        # the schema goes by position unless the header is compared with it
        options = {"header": "true", "enforceSchema": "false", "escape": '"', "multiLine": "true"} | options
    df = reader.options(**options).load(source.path) if source.path else reader.options(**options).load()
    if not source.schema:
        back = {v: k for k, v in source.columns.items()}
        return df.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in df.columns])
    found, out = {f.name: f for f in df.schema}, []
    for f in source.schema:
        have = found.get(named[f.name])
        if have is None:
            raise ValueError(f"column {named[f.name]} is missing")
        c = F.col(f"`{have.name}`")
        if source.format == "csv" and _nested(f):
            c = F.from_json(c, f.dataType)
        elif have.dataType != f.dataType:
            raise ValueError(f"column {have.name} is {have.dataType.simpleString()}, not {f.dataType.simpleString()}")
        out.append(c.alias(f.name))
    return df.select(*out)


class SourceTables(SnapshotTables):
    """Application tables, each from a reader of its own; tables without a
    source are snapshots under ``root``."""

    def __init__(self, spark: SparkSession, sources: dict[str, TableSource], root: str):
        super().__init__(spark, root)
        self.sources = sources

    def read(self, name: str) -> DataFrame:
        if name in self.sources:
            return read_table(self.spark, self.sources[name])
        return super().read(name)
