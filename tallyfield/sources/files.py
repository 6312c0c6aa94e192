"""Landed files as tables: schema guards, feeds of several shapes, caches and archives."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.text import html_text


class MissingColumns(ValueError):
    """A feed lacks columns that it must have."""


def require_columns(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    """The table, if it has the columns; checked before anything runs."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise MissingColumns(f"{what} lacks {', '.join(lacking)}")
    return df


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    """The table, if it has a row."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def read_json(spark: SparkSession, path: str, schema: StructType | str, nan_to_null: bool = True) -> DataFrame:
    """JSON by a given schema; unreadable records are left out and NaN becomes null."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return without_nan(df) if nan_to_null else df


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities of double and float columns as null."""
    return df.select(*[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def read_csv(spark: SparkSession, paths: list[str] | str, schema: StructType | str) -> DataFrame:
    """CSV with a header by a given schema; columns are matched by place, short lines are filled with null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(paths)


def read_merged(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet of drifting columns as one table; a column that a file lacks is null."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def two_shapes(df: DataFrame, body: str, as_map: str, as_rows: str, key: str, value: Column, map_value: Column) -> DataFrame:
    """(key, value) of a JSON text that is a map of objects or an array of objects.

    as_map and as_rows are the schemas of the two shapes; value reads from row, map_value from v.
    A text of neither shape is an error of the query, unless it is null.
    """
    kind = F.substring(F.trim(F.col(body)), 1, 1)
    ok = F.when(F.col(body).isNotNull() & ~kind.isin("{", "["), F.raise_error(F.lit("neither a map nor a list"))).otherwise(F.lit(True))
    d = df.where(ok).select(F.when(kind == "{", F.from_json(body, as_map)).alias("m"), F.when(kind == "[", F.from_json(body, as_rows)).alias("r"))
    a = d.select(F.explode("m").alias(key, "v")).select(F.col(key).cast("string"), map_value.alias("value"))
    b = d.select(F.explode("r").alias("row")).select(F.col(f"row.{key}").cast("string").alias(key), value.alias("value"))
    return a.unionByName(b)


def fresh_or_fetch(spark: SparkSession, landing: str, now: datetime, fetch: Callable[[], str], hours: int = 24) -> DataFrame:
    """The newest landed copy (fetched_utc, body) that is young enough and readable, else a new one.

    A copy whose body isn't a JSON object or array is never trusted.
    """
    schema = "fetched_utc timestamp, body string"
    try:
        old = spark.read.schema(schema).parquet(landing)
        newest = old.where(F.col("fetched_utc") > F.lit(now - timedelta(hours=hours))).orderBy(F.desc("fetched_utc")).limit(1).collect()
    except Exception as e:  # a landing folder that isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        newest = []
    if newest:
        try:
            if json.loads(newest[0]["body"]):
                return spark.createDataFrame(newest, schema)
        except (TypeError, ValueError):
            pass
    new = spark.createDataFrame([(now, fetch())], schema)
    new.write.mode("append").parquet(landing)
    return new


def html_tables(df: DataFrame, ident: str, html: str, header: str) -> DataFrame:
    """(ident, row_no, column_name, value) of the table whose head has the given column.

    Columns are found by the text of the last head row, never by place. A page without such a
    table gives an error row: row_no null and the reason in value.
    """
    rows = lambda c: F.regexp_extract_all(c, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    cells = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1), html_text)
    d = df.select(ident, F.regexp_extract(html, r"(?is)<thead[^>]*>(.*?)</thead>", 1).alias("head"), F.regexp_extract(html, r"(?is)<tbody[^>]*>(.*?)</tbody>", 1).alias("body"))
    d = d.select(ident, F.transform(F.slice(F.reverse(rows(F.col("head"))), 1, 1), cells).alias("heads"), rows(F.col("body")).alias("lines"))
    d = d.withColumn("names", F.coalesce(F.get("heads", F.lit(0)), F.array().cast("array<string>")))
    good = F.array_contains("names", header)
    bad = d.where(~good).select(ident, F.lit(None).cast("int").alias("row_no"), F.lit(header).alias("column_name"), F.lit("no such column").alias("value"))
    lines = d.where(good).select(ident, "names", F.posexplode("lines").alias("row_no", "line")).withColumn("cells", cells(F.col("line")))
    flat = lines.select(ident, "row_no", F.explode(F.arrays_zip("names", "cells")).alias("x")).where("x.names is not null")
    return flat.select(ident, "row_no", F.col("x.names").alias("column_name"), F.col("x.cells").alias("value")).unionByName(bad)


def flatten_markets(df: DataFrame, ident: str, body: str) -> DataFrame:
    """Open outcomes of nested events: one row for each of event > groups > markets > outcomes."""
    schema = "struct<id:string,groups:array<struct<markets:array<struct<name:string,status:string,period:string,outcomes:array<struct<name:string,status:string,american:string,decimal:double,handicap:double>>>>>>>"
    e = df.select(ident, F.from_json(body, schema).alias("e"))
    g = e.select(ident, F.col("e.id").alias("event"), F.explode("e.groups").alias("g"))
    m = g.select(ident, "event", F.explode("g.markets").alias("m")).where("m.status = 'O' and m.period = 'M'")
    o = m.select(ident, "event", F.col("m.name").alias("market"), F.explode("m.outcomes").alias("o")).where("o.status = 'O'")
    return o.select(ident, "event", "market", F.col("o.name").alias("outcome"), F.col("o.american").alias("american"), F.col("o.decimal").alias("decimal"), F.col("o.handicap").alias("line"))


def latest_usable(archive: DataFrame, keys: list[str], at: str, cutoff: Column | None, tie: str) -> DataFrame:
    """Per key the newest archived row before the cutoff; ties go to the greater tie column."""
    d = archive if cutoff is None else archive.where(F.col(at) < cutoff)
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return d.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def windows_of(spark: SparkSession, start: str, end: str, days: int = 31) -> DataFrame:
    """Half-open ranges of at most `days` days that cover [start, end)."""
    d = spark.sql(f"select explode(sequence(timestamp_ntz'{start}', timestamp_ntz'{end}' - interval 1 microsecond, interval {days} days)) as lo")
    return d.select("lo", F.least(F.col("lo") + F.expr(f"interval {days} days"), F.expr(f"timestamp_ntz'{end}'")).alias("hi"))


def columnar_observations(df: DataFrame, body: str) -> DataFrame:
    """Rows of {"columns": [...], "rows": [[...], ...]} as (row_no, column_name, value) texts."""
    o = df.select(F.from_json(body, "struct<columns:array<string>,rows:array<array<string>>>").alias("o"))
    r = o.select("o.columns", F.posexplode("o.rows").alias("row_no", "r"))
    return r.select("row_no", F.explode(F.arrays_zip(F.col("columns").alias("k"), F.col("r").alias("v"))).alias("x")).select("row_no", F.col("x.k").alias("column_name"), F.col("x.v").alias("value"))


def whole_files(df: DataFrame, path: str, read: Callable[[str], str]) -> DataFrame:
    """(path, body) of landed files that are read by the executors, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([read(p)])], names=["path", "body"])

    return df.select(F.col(path).cast("string")).mapInArrow(run, "path string, body string")
