"""Sharding by size-tiered compaction; DataFrame functions only.

append() writes arrivals as small immutable shards, one run each, of at most RUN_ROWS rows; it moves no rows. compact()
groups runs of similar size (a power of TIER_STEP) in the order of their paths until a group reaches the target, and
writes each group of two runs or more as one file; a run that has the target size, or has no other of its size, is left as
it is.

Each version is a manifest that lists all live shards. Data and manifest go to folders that no other attempt uses; the
version then exists once its pointer file, written whole under a name of this attempt, is renamed to the version's, which fails if
that is there already: a reader sees one version or the next, of two writers one must try again, and what a crashed attempt has
left is listed nowhere and stops no retry. The shared folder needs such a rename, as HDFS has it.

Rows keep all their columns, whatever their names, nulls and repeated rows included; a null text counts as 0 bytes. Ids
keep their type; least and greatest ids of text are by its order. An empty table gives a manifest without shards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardgrid.sources.publish import content_of, publish

RUN_ROWS = 1024
TARGET_BYTES = 8 << 20  # of text
TIER_STEP = 4
ROW_BYTES = 64  # what a row counts for at least, so that a group of rows without text is bounded too
BLOCK = 1024  # runs whose sizes are summed in one task
TASK_BYTES = 128 << 20  # of text that one task rewrites


def fresh(root: str, kind: str, version: int) -> str:
    """A folder of this attempt alone."""
    return f"{root}/{kind}/{version}-{uuid.uuid4().hex}"


def commit(manifest: DataFrame, root: str, version: int) -> None:
    """Publish a version of the manifest, whole or not at all."""
    spark, place = manifest.sparkSession, fresh(root, "manifests", version)
    manifest.write.parquet(place)
    try:
        publish(spark, f"{root}/versions", str(version), f"{place}\n{manifest.schema['min_id'].dataType.simpleString()}")
    except FileExistsError as e:
        raise FileExistsError(f"version {version} of {root} is committed already") from e


def read_manifest(spark: SparkSession, root: str, version: int) -> DataFrame:
    place, kind = content_of(spark, f"{root}/versions", str(version)).split("\n")
    return spark.read.schema(f"shard string, folder string, tier int, n_rows long, n_bytes long, min_id {kind}, max_id {kind}").parquet(place)


def read_files(spark: SparkSession, schema: StructType, *places: str) -> DataFrame:
    """(row, shard) of all files below some folders; names of folders are no columns."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*places)
    return rows.select(F.struct(*[rows[f"`{c}`"] for c in schema.names]).alias("row"), rows.metadataColumn("_metadata")["file_path"].alias("shard"))


def described(rows: DataFrame, folder: str) -> DataFrame:
    """Manifest rows of what was just written, from the files themselves."""
    size = F.coalesce(F.octet_length("row.text").cast("long"), F.lit(0))
    sums = rows.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"), F.min("row.doc_id").alias("min_id"), F.max("row.doc_id").alias("max_id"))
    tier = F.floor(F.log(F.greatest(F.col("n_bytes"), F.lit(1)).cast("double")) / F.log(F.lit(float(TIER_STEP)))).cast("int")
    return sums.select("shard", F.lit(folder).alias("folder"), tier.alias("tier"), "n_rows", "n_bytes", "min_id", "max_id")


def append(docs: DataFrame, root: str, version: int) -> None:
    """Write docs as small shards and commit them together with the shards of the version before."""
    spark, place = docs.sparkSession, fresh(root, "data", version)
    docs.write.option("maxRecordsPerFile", RUN_ROWS).option("compression", "zstd").parquet(place)
    added = described(read_files(spark, docs.schema, place), place)
    commit(added if version == 0 else read_manifest(spark, root, version - 1).unionByName(added), root, version)


def merge_groups(manifest: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """(shard, folder, n_bytes, merged): runs below the target, with the group of similarly sized runs that each joins.

    Running sums of a tier go by blocks of runs, so that no task holds all runs of a tier. Runs alone in their group are
    not in the result.
    """
    weight = F.greatest(F.col("n_bytes"), F.col("n_rows") * ROW_BYTES)
    small = manifest.where(F.col("n_bytes") < target).withColumn("block", F.pmod(F.xxhash64("shard"), F.greatest(F.lit(1), F.ceil(F.lit(manifest.count()) / BLOCK))))
    inside = Window.partitionBy("tier", "block").orderBy("shard")
    blocks = small.groupBy("tier", "block").agg(F.sum(weight).alias("total")).withColumn("before", F.sum("total").over(Window.partitionBy("tier").orderBy("block")) - F.col("total")).drop("total")
    placed = small.withColumn("own", F.sum(weight).over(inside) - weight).join(blocks, ["tier", "block"])
    grouped = placed.select("shard", "folder", "n_bytes", F.concat_ws("-", "tier", F.floor((F.col("before") + F.col("own")) / target)).alias("merged"))
    return grouped.withColumn("n", F.count("*").over(Window.partitionBy("merged"))).where("n > 1").drop("n")


def compact(spark: SparkSession, schema: StructType, root: str, version: int, target: int = TARGET_BYTES) -> None:
    """Merge the small shards of a version and commit the result as the next version; old files stay readable."""
    manifest = read_manifest(spark, root, version)
    groups = merge_groups(manifest, target)
    total = groups.agg(F.sum("n_bytes")).first()[0]
    if total is None:  # nothing to merge
        commit(manifest, root, version + 1)
        return
    folders = [r[0] for r in groups.select("folder").distinct().collect()]  # one for each append or compaction that has small runs left
    key = "merged"
    while key.lower() in {c.lower() for c in schema.names}:
        key += "_"
    moved = read_files(spark, schema, *folders).join(groups.select("shard", F.col("merged").alias("group")), "shard").select("row.*", F.col("group").alias(key))
    place = fresh(root, "data", version + 1)
    # a group is at most the target and one run more; a task writes its groups one after the other
    moved.repartition(max(1, -(-total // TASK_BYTES)), key).write.option("compression", "zstd").partitionBy(key).parquet(place)
    added = described(read_files(spark, schema, place), place)
    commit(manifest.join(groups.select("shard"), "shard", "left_anti").unionByName(added), root, version + 1)


def shard_documents(docs: DataFrame, root: str, target: int = TARGET_BYTES) -> DataFrame:
    """Append docs under root, compact them, and return the manifest of the last version with its version number."""
    append(docs, root, 0)
    compact(docs.sparkSession, docs.schema, root, 0, target)
    return read_manifest(docs.sparkSession, root, 1).withColumn("version", F.lit(1))
