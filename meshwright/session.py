"""Session helpers: reading tables, the shared folder, and cutting lineage.

Every operator takes and returns DataFrames; the few that must iterate cut their
lineage by writing a table into the folder that all executors share.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (a file or a directory)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master, where one process reads and writes, may leave it unset: it
    gets a temporary folder that goes with the process. A cluster without the
    setting is refused, since each executor would write to its own disk.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="meshwright-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        sc.setCheckpointDir(made)
        where = sc.getCheckpointDir() or made
    return where.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/meshwright/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str = "t", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back.

    The result has no lineage above the files, survives the loss of any
    executor, and can be read many times without computing ``df`` again.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables this application has written; results not yet read are lost with them.

    Derived graphs are forgotten too and made anew when asked for.
    """
    from meshwright.operators.graph import forget

    forget(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
