"""Intermediate results that several later steps read: tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder with a local master; on a cluster, executors would not share one, and this raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local_folder:
        _local_folder.append("file://" + tempfile.mkdtemp(prefix="loom-"))
    return _local_folder[0]


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose rows are dealt over all cores, where it has fewer partitions than there are cores: for small inputs whose rows cost far more to parse than to move. Larger inputs stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores)


class Scratch:
    """The tables that one run writes. ``close`` deletes them; what is still open at exit goes then."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/loom/run-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: its plan ends here, and a lost executor costs no recomputation."""
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass
