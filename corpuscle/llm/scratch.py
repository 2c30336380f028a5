"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpuscle-")
        atexit.register(shutil.rmtree, root[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _remove(spark: SparkSession, root: str) -> None:
    """Delete a folder at the end of the program, if the session is still there or the folder is a plain one."""
    if root.startswith(("file:", "/")):
        shutil.rmtree(root.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    try:
        _delete(spark, root)
    except Exception:  # noqa: BLE001 - the session is gone, and with it the way to its file system
        pass


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written tables of one operator call. ``keep`` writes and rereads; ``drop`` removes tables no plan needs any more; the rest goes when the program ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        # results are lazy, so what they read stays as long as the program runs
        atexit.register(_remove, spark, self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table read back: an executor lost later costs a reread, not a recomputation."""
        path = f"{self.root}/{self.n:03d}-{name}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that are no longer referenced, now and not when its heap fills."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            _delete(self.spark, df._scratch_path)
