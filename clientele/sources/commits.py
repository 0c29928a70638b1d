"""A log of numbered commits under a folder: each number can be taken by one writer only.

A commit is one small file that appears whole or not at all. Locally it is linked to its
name, elsewhere renamed without overwriting; both fail where the name exists. A file system
that renames over existing files, such as a plain object store, is safe for one writer only.
"""

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Taken(Exception):
    """Another writer committed first."""


class Missing(Exception):
    """There is no such commit, or not any more."""


def _open(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def kinds(spark: SparkSession, root: str) -> dict[str, list[int]]:
    """The numbers of all commits under ``root`` by kind, in order."""
    path, files = _open(spark, root)
    if not files.exists(path):
        return {}
    found: dict[str, list[int]] = {}
    for status in files.listStatus(path):
        kind, _, number = status.getPath().getName().partition("=")
        if number.isdigit() and status.isFile():
            found.setdefault(kind, []).append(int(number))
    return {kind: sorted(taken) for kind, taken in found.items()}


def numbers(spark: SparkSession, root: str, kind: str) -> list[int]:
    """The commits of ``kind`` under ``root``, in order."""
    return kinds(spark, root).get(kind, [])


def read(spark: SparkSession, root: str, kind: str, number: int) -> dict:
    path, files = _open(spark, root)
    try:
        stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(path, f"{kind}={number}"))
    except Py4JJavaError as error:
        if "FileNotFound" in error.java_exception.getClass().getName():
            raise Missing(f"{kind}={number}") from error
        raise
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, kind: str, number: int, entry: dict) -> None:
    """Make ``entry`` the commit ``number``; raises ``Taken`` where that exists, whoever made it."""
    jvm = spark._jvm
    path, files = _open(spark, root)
    files.mkdirs(path)
    draft = jvm.org.apache.hadoop.fs.Path(path, f".{kind}-{uuid.uuid4().hex}")
    target = jvm.org.apache.hadoop.fs.Path(path, f"{kind}={number}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    try:
        if files.getUri().getScheme() == "file":
            names = [jvm.java.nio.file.Path.of(p.toUri().getPath(), _array(spark, jvm.java.lang.String)) for p in (target, draft)]
            jvm.java.nio.file.Files.createLink(*names)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(draft, target, _array(spark, jvm.org.apache.hadoop.fs.Options.Rename))
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise Taken(f"{kind}={number}") from error
        raise
    finally:
        files.delete(draft, False)


def remove(spark: SparkSession, folder: str) -> bool:
    """Delete a folder or file; False where there is none."""
    path, files = _open(spark, folder)
    return files.delete(path, True)


def _array(spark: SparkSession, kind):
    return spark.sparkContext._gateway.new_array(kind, 0)
