"""Tables between two steps of a plan, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def path(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir.

    Where that is unset a folder of the warehouse serves a local session; on a cluster it is an error,
    as nothing says which folder all machines see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back, which cuts the lineage."""
    where = path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def discard(frame: DataFrame) -> None:
    """Delete the folder of a frame that materialise() made and that nothing reads any more."""
    spark = frame.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in frame.inputFiles()}:
        gone = spark._jvm.org.apache.hadoop.fs.Path(folder)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
