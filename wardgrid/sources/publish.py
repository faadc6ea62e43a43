"""Names that exist whole or not at all, for tables that readers see change from one version to the next.

The content of a name is written to a file of this attempt alone, and that file is renamed to the name without replacing: a
reader finds the name with all its content or does not find it, and of two writers of one name the second fails. This needs a
file system whose rename is one step and does not replace when asked not to, as HDFS and its like are; on a store of objects, where
a rename is a copy, give the name to a store with conditional puts instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _paths(spark: SparkSession, path: str):
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    return of, of.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, folder: str, name: str, content: str) -> None:
    """Create <folder>/<name> with the content; FileExistsError if it is there. Leftovers of crashed attempts start with '.'."""
    draft, store = _paths(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    final, _ = _paths(spark, f"{folder}/{name}")
    if store.exists(final):
        store.delete(draft, False)
        raise FileExistsError(f"{folder}/{name} is there already")
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    keep = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, final, keep)
    except Exception as e:
        store.delete(draft, False)
        if store.exists(final):
            raise FileExistsError(f"{folder}/{name} is there already") from e
        raise


def content_of(spark: SparkSession, folder: str, name: str) -> str:
    """The content of a published name; FileNotFoundError if there is none."""
    path, store = _paths(spark, f"{folder}/{name}")
    if not store.exists(path):
        raise FileNotFoundError(f"{folder}/{name}")
    stream = store.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """All published names, in order."""
    path, store = _paths(spark, folder)
    if not store.exists(path):
        return []
    return sorted(n for n in (s.getPath().getName() for s in store.listStatus(path)) if not n.startswith("."))
