"""Session settings and the shared folder for checkpoints and intermediate tables."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on; cluster sizing stays with the caller."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    Only a local-mode session that has none set gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="meterfold-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``drop_scratch`` removes what was written there."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete all intermediate tables of this driver; results that still read them end with it.

    They are read lazily, so only the caller knows when nothing needs them any more.
    """
    n = len(_scratch)
    while _scratch:
        old = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return n


def checkpointed(df):
    """Reliable checkpoint in the shared folder: survives executor loss, keeps partitions."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
