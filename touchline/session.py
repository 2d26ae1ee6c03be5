"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import pathlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators rely on. UTC keeps NTZ <-> timestamp casts
# free of daylight-saving shifts; AQE splits skewed join partitions and turns
# joins into broadcasts only after it has measured the side.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    _importable(spark.sparkContext)
    return spark


def _importable(context) -> None:
    """Python workers started from another folder find this package where the driver found it."""
    root = str(pathlib.Path(__file__).resolve().parents[1])
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, name: str = "touchline"):
    """A session for tests and the benchmark on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's own checkpoint folder.

    Only a local master may do without (tests, one machine): a fresh folder is
    made and set for the session there. A cluster without one is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if configured is None and not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="touchline-"))
        current = context.getCheckpointDir()
    return configured or current


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused location inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so later plans read fixed rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
