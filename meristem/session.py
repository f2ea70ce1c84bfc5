"""Session helpers shared by operators that iterate."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where none is set, local sessions get a temporary one; a cluster has to name one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="meristem-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise as a checkpoint in the shared folder and cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by columns over spark.sql.shuffle.partitions partitions, before each becomes many: adaptive execution would merge partitions by their size up to here."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


class Scratch:
    """Tables of an iteration, written in the shared folder.

    Unlike a checkpoint, a written table doesn't carry its plan's size estimate on, which joins
    multiply from round to round; and a round's tables can be dropped once the next one has its own.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_older(self, *names: str) -> None:
        """Removes all but the newest table of each name."""
        jvm = self.spark._jvm
        for name in names:
            for path in self.paths.get(name, [])[:-1]:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
            self.paths[name] = self.paths.get(name, [])[-1:]
