"""Work that concerns the session: shipping the package and cutting lineage.

Intermediate results that must not be recomputed (model calls, loop state) are
written as Parquet below the folder the cluster names in ``spark.checkpoint.dir``
so that they survive the loss of any executor.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped_to: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, for where it is not installed on them."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped_to:
        package = Path(__file__).parent
        archive = f"{tempfile.mkdtemp(prefix='pairrank-')}/pairrank"
        sc.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))
        _shipped_to.add(sc.applicationId)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder, or where none is set one below the warehouse, which is shared as well."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once below the checkpoint folder and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/pairrank/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measure(*tables: DataFrame) -> list[tuple[int, int]]:
    """For each table, its rows and how many tasks hold any of them, in one job."""
    placed = [t.select(F.lit(i).alias("table"), F.spark_partition_id().alias("part")) for i, t in enumerate(tables)]
    per_task = reduce(DataFrame.unionAll, placed).groupBy("table", "part").agg(F.count("*").alias("n"))
    sizes = {r.table: (r.n, r.tasks) for r in per_task.groupBy("table").agg(F.sum("n").alias("n"), F.count("*").alias("tasks")).collect()}
    return [sizes.get(i, (0, 0)) for i in range(len(tables))]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a table that would keep only some of the session's task slots busy.

    For work that is heavy per row. A table with enough input splits is left where it is.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, *keys) if measure(df)[0][1] < slots else df
