"""File names, folders, first lines and small text files through the Hadoop file
system, which is what Spark's own readers use, so any path they can read works here.

Only metadata, first lines and the manifest's changes pass through the driver.
"""

from __future__ import annotations

import re
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# First lines read side by side.
READERS = 16


@dataclass(frozen=True)
class Entry:
    name: str  # as it is on disk, not percent-encoded
    path: str
    is_dir: bool


def _at(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def entries(spark: SparkSession, folder: str) -> list[Entry]:
    """What lies directly in ``folder``, by name; nothing for a missing folder."""
    fs, p = _at(spark, folder)
    if not fs.exists(p):
        return []
    made = [Entry(s.getPath().getName(), s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(p)]
    return sorted(made, key=lambda e: e.name)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def make(spark: SparkSession, folder: str) -> None:
    fs, p = _at(spark, folder)
    fs.mkdirs(p)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the folders that match a pattern."""
    fs, p = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or () if s.isDirectory())


def move(spark: SparkSession, path: str, into: str, name: str | None = None) -> None:
    """Move a file into a folder (made if missing), within one file system."""
    fs, p = _at(spark, path)
    _, folder = _at(spark, into)
    fs.mkdirs(folder)
    target = spark._jvm.org.apache.hadoop.fs.Path(folder, name or p.getName())
    if not fs.rename(p, target):
        raise OSError(f"cannot move {path} to {into}")


def copy(spark: SparkSession, path: str, target: str) -> None:
    """Copy a file as a stream."""
    fs, p = _at(spark, path)
    to, t = _at(spark, target)
    to.mkdirs(t.getParent())
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, t, False, spark._jsc.hadoopConfiguration()):
        raise OSError(f"cannot copy {path}")


def write(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Write a small text file. Without ``replace`` the file is made only if there is
    none yet, which the file system decides between writers; whether it was made."""
    fs, p = _at(spark, path)
    try:
        out = fs.create(p, replace)
    except Py4JJavaError as e:
        if not replace and fs.exists(p):
            return False
        raise e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def text(spark: SparkSession, path: str, last: int | None = None) -> str:
    """A small text file, or its ``last`` bytes; empty if it is gone."""
    fs, p = _at(spark, path)
    try:
        size = fs.getFileStatus(p).getLen()
        stream = fs.open(p)
    except Py4JJavaError:
        if fs.exists(p):
            raise
        return ""
    try:
        if last is not None:
            stream.seek(max(0, size - last))
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def age(spark: SparkSession, path: str) -> float:
    """Seconds since a file was last written or touched (0 if it is gone)."""
    fs, p = _at(spark, path)
    return time.time() - fs.getFileStatus(p).getModificationTime() / 1000 if fs.exists(p) else 0.0


def touch(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.setTimes(p, int(time.time() * 1000), -1)


def first_lines(spark: SparkSession, path: str, n: int = 1) -> list[str]:
    """The first lines of a text file (fewer if it has fewer); reads no more."""
    fs, p = _at(spark, path)
    io = spark._jvm.java.io
    reader = io.BufferedReader(io.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        lines = []
        while len(lines) < n and (line := reader.readLine()) is not None:
            lines.append(line)
        return lines
    finally:
        reader.close()


def heads(spark: SparkSession, paths: list[str], n: int) -> list[list[str]]:
    """The first lines of each file, read side by side."""
    with ThreadPoolExecutor(max_workers=READERS) as pool:
        return list(pool.map(lambda p: first_lines(spark, p, n), paths))


def literal(path: str) -> str:
    """``path`` for a Spark reader, which takes some characters as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def hidden(name: str) -> bool:
    """Names that Spark's readers pass over without a word."""
    return name.startswith((".", "_"))
