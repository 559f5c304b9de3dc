"""Cut lineage with tables written to the shared checkpoint folder.

Intermediate results that are used more than once are written as Parquet below the folder named by
``spark.checkpoint.dir``. They survive the loss of executors, and their file sizes give the planner
measured statistics to choose join strategies from.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a folder in its warehouse. Never a temporary folder:
    the executors of a cluster could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tidemill/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return a reader of the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False where it is there already. Of callers at the same time one gets True, as far as the file
    system creates files atomically (HDFS does)."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        return file.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(file)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise


def side_by_side(work: Callable, items: Iterable, at_once: int = 4) -> list:
    """Run independent jobs at the same time; small ones would leave most of a cluster idle."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(work, items))


def release(*staged: DataFrame) -> None:
    """Remove staged tables whose every reader has been written elsewhere."""
    for df in staged:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if f"{shared_folder(spark).split(':')[-1].lstrip('/')}/tidemill/" in folder.toString():
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
