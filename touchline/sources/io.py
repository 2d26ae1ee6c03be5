"""Readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.sets import present


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None):
    """Parquet with column and row selection left to the scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema (no inference pass)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def read_by_suffix(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet for ``.parquet``, CSV for anything else."""
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    return read_csv(spark, path, schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def read_optional(spark: SparkSession, path: str, empty_schema: str) -> DataFrame:
    """The dataset, or an empty frame with its key columns when absent."""
    if path_exists(spark, path):
        return spark.read.parquet(path)
    return spark.createDataFrame([], empty_schema)


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    """A contract table without rows."""
    return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, partitions: Sequence[str] = (), compression: str | None = None):
    """Overwrite a parquet dataset, partitioned when asked."""
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)


def layer_path(base: str, layer: str, dataset: str) -> str:
    return f"{base.rstrip('/')}/{layer}/{dataset}"


def write_layer(df: DataFrame, base: str, layer: str, dataset: str, partitions: Sequence[str] = ()):
    """Write a dataset of a lake layer."""
    write_table(df, layer_path(base, layer, dataset), partitions)


def read_layer(spark: SparkSession, base: str, layer: str, dataset: str) -> DataFrame:
    """Read a dataset of a lake layer; partition columns are discovered."""
    return spark.read.parquet(layer_path(base, layer, dataset))


def materialise_layers(datasets: dict[tuple[str, str], DataFrame], base: str):
    """Write each ``(layer, dataset)`` of the lake."""
    for (layer, dataset), df in datasets.items():
        write_layer(df, base, layer, dataset)


def write_report(df: DataFrame, path: str):
    """CSV report with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_marts(df: DataFrame, base: str, marts: dict[str, Sequence[str]]):
    """Several projections of one frame; it is computed once."""
    cached = df.persist()
    try:
        for name, columns in marts.items():
            write_table(cached.select(*[F.col(f"`{c}`") for c in columns]), f"{base.rstrip('/')}/{name}")
    finally:
        cached.unpersist()


def write_extract(df: DataFrame, path: str, required: Sequence[str]):
    """Compact serving extract: the required columns that exist, zstd."""
    columns = present(df, required)
    write_table(df.select(*[F.col(f"`{c}`") for c in columns]), path, compression="zstd")
    return columns


def run_metrics(df: DataFrame, **counters: Column) -> DataFrame:
    """One row with the counters of a run and its status.

    ``errors`` and ``succeeded`` decide between failed, partial and success.
    """
    counted = df.agg(*[c.alias(n) for n, c in counters.items()])
    return counted.withColumn("status", run_status(F.col("errors"), F.col("succeeded")))


def record_run(df: DataFrame, path: str, run_id: str, started_at: Column, finished_at: Column, **counters: Column):
    """Append the counters and status of one run to the run log."""
    metrics = run_metrics(df, **counters)
    stamped = metrics.select(
        F.lit(run_id).alias("run_id"), started_at.cast("timestamp").alias("started_at"),
        finished_at.cast("timestamp").alias("finished_at"), "*",
    )
    stamped.coalesce(1).write.mode("append").parquet(path)


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """The row of the run that finished last (ties: largest id); no rows if the log holds none."""
    log = spark.read.parquet(path)
    last = F.max_by(F.struct(*log.columns), F.struct("finished_at", "run_id"))
    return log.agg(last.alias("_run")).where("_run is not null").select("_run.*")


def run_status(errors: Column, succeeded: Column) -> Column:
    """Failed, partial_success or success."""
    return (
        F.when((errors > 0) & (succeeded == 0), "failed")
        .when(errors > 0, "partial_success")
        .otherwise("success")
    )


def register_views(frames: dict[str, DataFrame]):
    """Staging and intermediate models as temporary views."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
