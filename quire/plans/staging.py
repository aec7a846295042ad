"""Tables written to the folder that driver and executors share, and read again.

A staged table cuts the lineage of a long plan: what was written survives the loss of
any executor, and a later action reads it instead of computing it again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where none is set, on one machine alone, a new local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet under a new path in the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a path under the shared folder."""
    if not path.startswith(f"{shared_dir(spark)}/quire/"):
        raise ValueError(f"{path} is not in the shared folder")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/quire/"
    inside = root.split("://")[-1].replace("file:", "")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if inside in folder:
            removed(spark, root + folder.split(inside, 1)[1])


def shipped(spark: SparkSession, value):
    """A function that gives value inside any task; value goes to each executor once, with its classes' code.

    For values of a bounded size, such as trained models.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list = []

    def get():
        if not held:
            held.append(cloudpickle.loads(sent.value))
        return held[0]

    return get


def fresh(columns, name: str) -> str:
    """name, with a number after it if a column (in any case) is already called so."""
    taken, out, k = {c.lower() for c in columns}, name, 0
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out
