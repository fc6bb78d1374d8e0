"""Numbered manifests in a folder: a new one is published whole, or not at all if its number is taken.

Works on the file systems that Spark's Hadoop configuration knows. A manifest is written under another name
and then moved to its own; the move fails if the name is there. It is atomic on HDFS and local disks, on an
object store as far as its rename or its committer is.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none where it is not there."""
    fs, p = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def bytes_in(spark: SparkSession, folder: str) -> int:
    fs, p = _path(spark, folder)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def load(spark: SparkSession, path: str) -> dict:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, content: dict) -> bool:
    """Whether the manifest now stands at path; False if another one is there already."""
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    fs, p = _path(spark, draft)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    try:
        return _move(spark, fs, p, path)
    finally:
        fs.delete(p, False)


def _context(spark: SparkSession, fs):
    return spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())


def _move(spark: SparkSession, fs, draft, path: str) -> bool:
    if fs.getUri().getScheme() == "file":  # its rename replaces what is there; a second link to the draft does not
        local = spark._jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority
        try:
            os.link(local(draft).toString(), local(spark._jvm.org.apache.hadoop.fs.Path(path)).toString())
        except FileExistsError:
            return False
        return True
    jvm = spark._jvm
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        _context(spark, fs).rename(draft, jvm.org.apache.hadoop.fs.Path(path), options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception):
            return False
        raise
    return True
