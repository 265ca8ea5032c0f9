"""Tables with a current version: written beside the old one, current once they are whole.

A version is a numbered folder, and counts once its writer's _SUCCESS file stands in it; readers take the last that
counts, so a run that fails or loses its driver leaves the one before as it was.  One writer at a time: a second
that takes the same number fails, as a folder is never written twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, root: str, whole: bool) -> list[int]:
    fs, at = _folder(spark, root)
    if not fs.exists(at):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(int(n) for n in found if n.isdigit() and (not whole or exists(spark, f"{root}/{n}/_SUCCESS")))


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def versions(spark: SparkSession, root: str) -> list[str]:
    """The folders of all versions that count, oldest first."""
    return [f"{root}/{n:08d}" for n in _numbers(spark, root, True)]


def publish(df: DataFrame, root: str) -> str:
    """Writes df as the next version and returns its folder."""
    spark = df.sparkSession
    path = f"{root}/{max(_numbers(spark, root, False), default=0) + 1:08d}"
    df.write.mode("errorifexists").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)
    return path


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The last version that counts; None where there is none."""
    found = versions(spark, root)
    return spark.read.parquet(found[-1]) if found else None


def retire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes all but the last ``keep`` versions that count; versions begun and not finished before the last that counts go too."""
    held = versions(spark, root)
    last = held[-1] if held else ""
    gone = [f"{root}/{n:08d}" for n in _numbers(spark, root, False) if f"{root}/{n:08d}" not in held[-keep:] and f"{root}/{n:08d}" < last]
    for path in gone:
        delete(spark, path)
    return gone
