"""The few file operations that tables need from the driver: names only, never contents."""

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _open(spark, path)
    fs.delete(p, True)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _open(spark, path)
    fs.mkdirs(p)


def matching(spark: SparkSession, *patterns: str) -> list[str]:
    """Paths that fit a pattern with ``*`` or ``{a,b}``, in one request for each pattern."""
    found = []
    for pattern in patterns:
        fs, p = _open(spark, pattern)
        found += [s.getPath().toString() for s in (fs.globStatus(p) or [])]
    return sorted(found)


def value(path: str, name: str) -> str:
    """The part of a path after ``name=``."""
    return next(x for x in path.split("/") if x.startswith(f"{name}=")).split("=", 1)[1]
