"""File-system calls through Hadoop, so any scheme Spark can read works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _resolve(spark, path)
    return fs.exists(p)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True if a Spark job finished writing the folder."""
    return exists(spark, f"{path}/_SUCCESS")


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a glob pattern, as given by the file system."""
    fs, p = _resolve(spark, pattern)
    found = fs.globStatus(p) or []
    return sorted(s.getPath().toString() for s in found if s.isDirectory())


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder; False if it was not there."""
    fs, p = _resolve(spark, path)
    return fs.delete(p, True)


def size_of_tree(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number of files and of folders below a folder; one call."""
    fs, p = _resolve(spark, path)
    if not fs.exists(p):
        return 0, 0
    found = fs.getContentSummary(p)
    return found.getFileCount(), found.getDirectoryCount() - 1


def has_data(spark: SparkSession, path: str) -> bool:
    """True if a folder holds anything but marker files, at any depth.  Stops at the
    first file."""
    fs, p = _resolve(spark, path)
    if not fs.exists(p):
        return False
    todo = [p]
    while todo:
        for status in fs.listStatus(todo.pop()):
            if status.getPath().getName().startswith(("_", ".")):
                continue
            if not status.isDirectory():
                return True
            todo.append(status.getPath())
    return False


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, or None if it is not there.  A run that ended while it put a new
    version in place has left that version aside, complete."""
    fs, p = _resolve(spark, path)
    if not fs.exists(p):
        _, p = _resolve(spark, f"{path}.new")
        if not fs.exists(p):
            return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file: aside first, then put in place."""
    fs, p = _resolve(spark, path)
    _, aside = _resolve(spark, f"{path}.new")
    stream = fs.create(aside, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    fs.delete(p, False)
    fs.rename(aside, p)
