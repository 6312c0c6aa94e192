"""Writers: latest and dated copies, immutable and content-addressed archives, newest-wins merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_hash


def write_latest_and_history(df: DataFrame, root: str, day: str, drop_from_history: list[str] | None = None) -> None:
    """latest is replaced; the day's partition of history is replaced, other days stay."""
    df.write.mode("overwrite").parquet(f"{root}/latest")
    history = df.drop(*(drop_from_history or [])).withColumn("day", F.lit(day))
    history.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{root}/history")


def history_index(spark: SparkSession, root: str) -> DataFrame:
    """(day, n) of the history, newest first."""
    return spark.read.parquet(f"{root}/history").groupBy("day").agg(F.count("*").alias("n")).orderBy(F.desc("day"))


def write_immutable(df: DataFrame, path: str, columns: list[str]) -> bool:
    """Write once. Writing equal content again is fine (False); different content is an error."""
    spark = df.sparkSession
    digest = lambda d: d.select(content_hash(*columns).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.mode("errorifexists").parquet(path)
        return True
    a, b = digest(df).withColumnRenamed("n", "n_new"), digest(old)
    if not a.join(b, "h", "full").where("n_new is null or n is null or n_new <> n").isEmpty():
        raise ValueError(f"{path} holds something else")
    return False


def archive_inputs(df: DataFrame, path: str, body: str) -> DataFrame:
    """Append the bodies that the archive lacks, each once under its SHA-256; rows come back with the hash instead."""
    spark = df.sparkSession
    hashed = df.withColumn("sha256", F.sha2(F.col(body), 256))
    new = hashed.where(F.col(body).isNotNull()).select("sha256", F.col(body).alias("body")).dropDuplicates(["sha256"])
    try:
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)
    return hashed.drop(body)


def newest_wins(current: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Per key the row of the greatest version; of equal versions the incoming one."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def write_csv_view(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
