"""Reading and writing the tables of the workflow."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, time, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fleetspark.schema import RAW_SCHEMA, TIME

#: Column by which stored tables are cut into folders, as text like 2024-01.
MONTH = "month"


def read_raw(spark: SparkSession, path: str | list[str], fmt: str = "csv", **options) -> DataFrame:
    """All-text export: one scan over any number of files, schema given, none inferred."""
    return spark.read.schema(RAW_SCHEMA).options(**options).format(fmt).load(path)


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A parquet path (anything with a slash) or a catalog table."""
    if "/" in name_or_path:
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


def read_range(
    spark: SparkSession, name_or_path: str, start: date | datetime, end: date | datetime
) -> DataFrame:
    """Rows of a stored table with start <= time < end; a date stands for its midnight.

    Where the table lies in folders by month, the months of the range are derived from
    its ends, so that other folders are not listed or read. Rows without a time are in no
    range, and an end at or before the start leaves none.
    """
    first, past = (x if isinstance(x, datetime) else datetime.combine(x, time()) for x in (start, end))
    df = read_table(spark, name_or_path)
    rows = df.filter((F.col(TIME) >= F.lit(first)) & (F.col(TIME) < F.lit(past)))
    if MONTH not in df.columns:
        return rows
    last = past - timedelta(microseconds=1)
    return rows.filter(F.col(MONTH).between(f"{first:%Y-%m}", f"{last:%Y-%m}"))


def read_jdbc(
    spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None
) -> DataFrame:
    """Result of a query run by a database.

    Without partitioning options in `properties` the result arrives in one task, so
    give `partitionColumn` and its bounds with `dbtable` for anything large.
    """
    options = dict(properties or {})
    if "dbtable" not in options:
        options["query"] = query
    return spark.read.format("jdbc").option("url", url).options(**options).load()


def write_table(
    df: DataFrame,
    path: str,
    if_exists: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> None:
    """Store a result as parquet.

    `if_exists` is "errorifexists" (create), "overwrite" (create or replace) or
    "ignore" (create if missing).  With `partition_by`, rows are first brought together
    by those columns; large groups are split over several files.
    """
    if if_exists not in ("errorifexists", "overwrite", "ignore"):
        raise ValueError(f"unknown mode {if_exists!r}")
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode(if_exists)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table whose size Spark knows (no Python workers)."""
    struct = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in struct.names]
    arrays = [
        pa.array(list(values), to_arrow_type(field.dataType))
        for values, field in zip(columns, struct.fields)
    ]
    return spark.createDataFrame(pa.table(arrays, names=struct.names), schema=struct)


def describe(df: DataFrame) -> list[tuple[str, str, bool]]:
    """(column, type, nullable) of a table."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]


def write_points_csv(points: DataFrame, path: str) -> None:
    """Points as CSV with a header: name, latitude, longitude."""
    points.select("name", "latitude", "longitude").write.mode("overwrite").option(
        "header", True
    ).csv(path)
