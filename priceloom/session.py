"""Session settings that the operators expect, and the folder that all executors share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A repeated name in a specification list keeps its last value.
SETTINGS = {"spark.sql.mapKeyDedupPolicy": "LAST_WIN"}

_LOCAL: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; in local mode a folder for this application if that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _LOCAL.setdefault(spark.sparkContext.applicationId, f"file:///tmp/priceloom-shared-{uuid.uuid4().hex}")
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/priceloom/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows of ``df``, which is cheap to count, dealt to all cores for costly work on each row: a small file would be one task."""
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, math.ceil(rows / 65_536), min(2 * cores, math.ceil(rows / 1024))))
