"""Canonical tables, readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardgrid.functions.clean import null_tokens
from wardgrid.sources import publish

#: Canonical schemas; "not null" columns are required.
SCHEMAS: dict[str, str] = {
    "stays": "patient_id string not null, subject_id string not null, stay_id string not null, dataset string not null, hospital_id string, age float not null, sex string not null, ethnicity string, weight float, height float, admit_time timestamp not null, discharge_time timestamp not null, los_hours float not null, mortality_in_icu boolean not null, mortality_in_hospital boolean, mortality_30day boolean, admission_diagnosis string",
    "events_long": "patient_id string not null, stay_id string not null, charttime timestamp not null, concept string not null, value float not null, unit string not null, unit_source string",
    "meds": "patient_id string not null, stay_id string not null, starttime timestamp not null, endtime timestamp, drug string not null, dose float, dose_unit string, route string, drug_class string not null",
    "interventions": "patient_id string not null, stay_id string not null, starttime timestamp not null, endtime timestamp, intervention string not null",
    "notes": "patient_id string not null, stay_id string, charttime timestamp not null, note_type string not null, text string not null",
    "diagnoses": "patient_id string not null, stay_id string, icd_code string not null, icd_version string not null, diagnosis_position int not null",
    "microbio": "patient_id string not null, stay_id string not null, charttime timestamp not null, specimen_type string not null, organism string",
    "abx_duration": "stay_id string not null, starttime timestamp not null, endtime timestamp",
}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(table))


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All-string CSV (plain or compressed) with null tokens as nulls; casts are the caller's, by try_cast."""
    raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
    return raw.select(*[null_tokens(F.col(c)).alias(c) for c in (columns or raw.columns)])


def exists(spark: SparkSession, path: str) -> bool:
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    return of.getFileSystem(spark._jsc.hadoopConfiguration()).exists(of)


def read_csv_or_empty(spark: SparkSession, path: str, columns: list[str], encoding: str = "UTF-8") -> DataFrame:
    """These columns of a CSV; an empty table where the file, or one of the columns, is not there."""
    if exists(spark, path):
        raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
        if set(columns) <= set(raw.columns):
            return raw.select(*[null_tokens(F.col(c)).alias(c) for c in columns])
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def canonical(rows: DataFrame, table: str) -> DataFrame:
    """rows in the columns and types of a canonical table, without those that lack a required value."""
    schema = schema_of(table)
    cast = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    return cast.dropna(subset=[f.name for f in schema if not f.nullable])


def read_strict_csv(spark: SparkSession, path: str, schema: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Quoted multi-line CSV whose ragged lines are errors; free-text columns are dropped."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path).drop(*drop)


def read_dictionary(spark: SparkSession, path: str, schema: str, rows: int | None = None) -> DataFrame:
    """A small typed dimension with '#' comments; its row count is checked if given."""
    dim = spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)
    if rows is not None and dim.count() != rows:
        raise ValueError(f"{path}: expected {rows} rows")
    return dim


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """(code, group), quotes and blanks stripped, one row per code."""
    raw = spark.read.option("header", True).csv(path)
    tidy = [F.trim(F.regexp_replace(F.col(c), "['\"]", "")).alias(n) for c, n in zip(raw.columns[:2], ("code", "group"), strict=True)]
    return raw.select(*tidy).groupBy("code").agg(F.min("group").alias("group"))


def read_run_metadata(spark: SparkSession, root: str) -> DataFrame:
    """JSON of each run with the model named by its directory, and whether its own field agrees."""
    raw = spark.read.option("multiLine", True).json(f"{root}/*/*/*/seed_*/metadata.json").withColumn("path", F.col("_metadata.file_path"))
    model = F.regexp_extract("path", r"/([^/]+)/seed_[^/]+/metadata\.json$", 1)
    return raw.withColumn("model_dir", model).withColumn("agrees", F.col("model") == model)


def read_parquet_parts(spark: SparkSession, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """These columns (all if None) of the Parquet files of a pattern, such as <root>/part-*.parquet; files may hold more columns."""
    raw = spark.read.option("mergeSchema", True).parquet(pattern)
    return raw if columns is None else raw.select(*columns)


def read_embeddings(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(note_id, embedding) of the wanted notes; the vector's column is the one of embedding, emb and vector that the files have."""
    raw = spark.read.parquet(root)
    named = [c for c in ("embedding", "emb", "vector") if c in raw.columns]
    if not named:
        raise ValueError(f"{root}: no column of vectors")
    return raw.select("note_id", F.col(named[0]).alias("embedding")).join(wanted.select("note_id").distinct(), "note_id", "left_semi")


def require_codes(dimension: DataFrame, locked: DataFrame, key: str) -> None:
    """Fail if a locked code is not in the source's dictionary."""
    gone = [r[0] for r in locked.join(dimension, key, "left_anti").select(key).limit(5).collect()]
    if gone:
        raise ValueError(f"codes missing from the source: {gone}")


def require_unique(rows: DataFrame, *keys: str) -> None:
    if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{keys} is not unique")


def validate(rows: DataFrame, table: str) -> None:
    """Missing column, other type or null in a required column is an error; extra columns are not."""
    have = {f.name: f.dataType for f in rows.schema}
    want = schema_of(table)
    wrong = [f.name for f in want if f.name not in have or have[f.name] != f.dataType]
    if wrong:
        raise ValueError(f"{table}: missing or of another type: {wrong}")
    required = [f.name for f in want if not f.nullable]
    nulls = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first().asDict()
    if any(nulls.values()):
        raise ValueError(f"{table}: nulls in {[c for c, n in nulls.items() if n]}")


def write_canonical(rows: DataFrame, table: str, path: str) -> None:
    """Cast, validate, write aside, then put in place by two renames, for exports that are plain folders of Parquet. A crash between
    the two leaves the old table under another name; publish_table() has no such gap."""
    cast = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of(table)])
    validate(cast, table)
    spark, mark = rows.sparkSession, uuid.uuid4().hex
    cast.write.option("compression", "zstd").parquet(f"{path}.new-{mark}")
    of = spark._jvm.org.apache.hadoop.fs.Path
    store = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(of(path)):
        store.rename(of(path), of(f"{path}.old-{mark}"))
    if not store.rename(of(f"{path}.new-{mark}"), of(path)):
        store.rename(of(f"{path}.old-{mark}"), of(path))
        raise OSError(f"{path} could not be replaced")
    store.delete(of(f"{path}.old-{mark}"), True)


def publish_table(rows: DataFrame, table: str, root: str) -> int:
    """Cast, validate and write a new version of a table under root; it is the current one from the step that names it, and until
    then the version before is. Returns the version's number; of two writers at once the later one gets the next number."""
    spark, place = rows.sparkSession, f"{root}/data/{uuid.uuid4().hex}"
    cast = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of(table)])
    validate(cast, table)
    cast.write.option("compression", "zstd").parquet(place)
    while True:
        version = len(publish.names(spark, f"{root}/versions"))
        try:
            publish.publish(spark, f"{root}/versions", f"{version:09d}", place)
            return version
        except FileExistsError:
            continue


def read_table(spark: SparkSession, table: str, root: str, version: int | None = None) -> DataFrame:
    """The current, or another, version of a published table; FileNotFoundError if there is none."""
    known = publish.names(spark, f"{root}/versions")
    if not known:
        raise FileNotFoundError(f"no version of {table} under {root}")
    name = known[-1] if version is None else f"{version:09d}"
    return spark.read.schema(schema_of(table)).parquet(publish.content_of(spark, f"{root}/versions", name))


def append_new(rows: DataFrame, path: str, key: str, per_file: int = 20_000) -> None:
    """Append the rows whose key is not written yet, in files of at most per_file rows. Of rows of one key in one batch, one is kept."""
    rows = rows.dropDuplicates([key])
    try:
        rows = rows.join(rows.sparkSession.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:  # the first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").option("maxRecordsPerFile", per_file).parquet(path)


def merge_by_dataset(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the datasets in new replace theirs in old."""
    return old.join(new.select("dataset").distinct(), "dataset", "left_anti").unionByName(new, allowMissingColumns=True)


def compare_exports(a: DataFrame, b: DataFrame, tolerance: float = 0.05) -> list[str]:
    """What differs: columns, types, or row counts by more than the tolerance."""
    out = [f"column {c}" for c in sorted(set(a.columns) ^ set(b.columns))]
    out += [f"type of {c}" for c, t in a.dtypes if c in b.columns and dict(b.dtypes)[c] != t]
    n, m = a.count(), b.count()
    return out + ([f"rows {n} and {m}"] if abs(n - m) > tolerance * max(n, m, 1) else [])
