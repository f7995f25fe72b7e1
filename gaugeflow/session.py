"""Session defaults and the shared working folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_type


def local_session(app: str = "gaugeflow", cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use spark-submit's."""
    partitions = 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """Zone-free timestamps are truncated through the session zone; pin it to UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_table(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """A small table held in the plan itself, so that its size is known to the planner."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = {f.name: pa.array([r[i] for r in rows], to_arrow_type(f.dataType))
               for i, f in enumerate(schema.fields)}
    return spark.createDataFrame(pa.table(columns), schema)


def settle(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Evaluate fitted constants and return them as a local table.

    For results whose size the program bounds, such as thresholds per model; a
    larger result is an error rather than a load on the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows of fitted constants")
    return local_table(df.sparkSession, rows, df.schema)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder all executors see.

    Only a local session may go without the setting; it then uses /tmp/checkpoints.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
