"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BROADCAST_ROWS = 1_000_000  # keys of rows that are broadcast at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session, whose executors
    are its driver, gets a folder of its own; on a cluster that is an error, as executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wardgrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write df into the shared folder and read it back: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def same_rows(left: DataFrame, right: DataFrame, *also: str) -> DataFrame:
    """Inner join on doc_id (null equals null), th, the hash of the text, and what is named; right's keys are left out."""
    keys = ["th", *also]
    other = right.select(F.struct("doc_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in keys], *[c for c in right.columns if c not in ("doc_id", *keys)])
    on = F.struct("doc_id") == F.col("_id")
    for c in keys:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return left.join(other, on).drop("_id", *[f"_{c}" for c in keys])


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id (null equals null) and hash of text are not in gone (doc_id, th).

    Up to BROADCAST_ROWS of gone are sent to all tasks, so texts stay where they are; beyond that both sides are shuffled.
    """
    gone = staged(gone.select("doc_id", "th").distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    gone = gone.select(F.struct("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th"))
    gone = F.broadcast(gone) if few else gone
    return docs.join(gone, (F.struct(docs["doc_id"].alias("doc_id")) == gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_th"]), "left_anti")


def words_of(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order; empty array for null or wordless text."""
    text = F.col(text) if isinstance(text, str) else text
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null id counts as the text ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % modulus


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: as a lambda's variable it is not copied into each place that names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows(items: Column, width: int) -> Column:
    """64-bit hashes of every `width` neighbours in an array of hashes; one hash of all if there are fewer, none of none."""

    def body(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return each

    return let(items, lambda h: F.when(F.size(h) > 0, body(h)).otherwise(F.array().cast("array<bigint>")))
