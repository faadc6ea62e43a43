"""Checks of built cohorts, and fingerprints of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDING = "severity string, check string, detail string"


def column_findings(rows: DataFrame, columns: list[str], min_rows: int, absent: tuple[str, ...] = ()) -> DataFrame:
    """Columns without values, or with one value, in tables of at least min_rows; one pass for all columns."""
    facts = rows.agg(F.count("*").alias("n"), *[F.struct(F.count(c).alias("n"), F.min(F.col(c).cast("string")).alias("lo"), F.max(F.col(c).cast("string")).alias("hi")).alias(f"_{c}") for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"_{c}").alias("f")) for c in columns])
    found = facts.where(F.col("n") >= min_rows).select(F.explode(each).alias("x")).select("x.c", "x.f.*")
    kind = F.when(F.col("n") == 0, "all_null").when(F.col("lo") == F.col("hi"), "constant")
    return found.withColumn("check", kind).where("check is not null").select(F.when(F.col("c").isin(*absent, ""), "info").otherwise("warning").alias("severity"), "check", F.col("c").alias("detail"))


def key_findings(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """How many keys occur more than once."""
    n = rows.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n")).where("n > 0")
    return n.select(F.lit("error").alias("severity"), F.lit(f"duplicate_{name}").alias("check"), F.col("n").cast("string").alias("detail"))


def membership_findings(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """How many stays of left are not in right."""
    n = left.select("stay_id").distinct().join(right.select("stay_id").distinct(), "stay_id", "left_anti").agg(F.count("*").alias("n")).where("n > 0")
    return n.select(F.lit("error").alias("severity"), F.lit(name).alias("check"), F.col("n").cast("string").alias("detail"))


def label_findings(outc: DataFrame, ceiling: float | None = None) -> DataFrame:
    """Labels that are missing, constant, without positives, or at the clip's ceiling throughout."""
    a = outc.agg(F.count("*").alias("n"), F.count("label_value").alias("k"), F.min("label_value").cast("double").alias("lo"), F.max("label_value").cast("double").alias("hi"))
    checks = [("label_empty", F.col("n") == 0), ("label_missing", F.col("k") < F.col("n")), ("label_constant", F.col("lo") == F.col("hi")), ("label_no_positive", F.col("hi") == 0)]
    if ceiling is not None:
        checks.append(("label_at_ceiling", F.col("lo") >= ceiling))
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in checks]))
    return a.select(F.explode(found).alias("check"), F.col("n").cast("string").alias("detail")).select(F.lit("error").alias("severity"), "check", "detail")


def hour_findings(dyn: DataFrame) -> DataFrame:
    """Negative hours, and stays whose hours have holes."""
    per = dyn.groupBy("stay_id").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"), F.count_distinct("hour").alias("k"))
    a = per.agg(F.sum((F.col("lo") < 0).cast("int")).alias("negative_hour"), F.sum((F.col("hi") - F.col("lo") + 1 != F.col("k")).cast("int")).alias("ragged_hours"))
    return a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in ("negative_hour", "ragged_hours")])).alias("x")).where("x.n > 0").select(F.lit("error").alias("severity"), "x.check", F.col("x.n").cast("string").alias("detail"))


def cohort_findings(sta: DataFrame, dyn: DataFrame, outc: DataFrame, concepts: list[str]) -> DataFrame:
    parts = [
        column_findings(sta, [c for c in sta.columns if c not in ("stay_id", "patient_id")], 10), column_findings(dyn, concepts, 500), label_findings(outc), hour_findings(dyn),
        key_findings(sta, ["stay_id"], "sta"), key_findings(dyn, ["stay_id", "hour"], "dyn"), membership_findings(sta, outc, "sta_not_outc"), membership_findings(outc, sta, "outc_not_sta"), membership_findings(dyn, outc, "dyn_not_outc"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fingerprint(rows: DataFrame) -> DataFrame:
    """(n_rows, digest): a hash of the content that does not depend on the order of rows, nor on the engine.

    A row is its columns by name, each as the length of its text and the text, -1 for null; the digest is the sum of the first 60 bits
    of the rows' MD5, so that any engine with MD5 gives the same. Numbers, dates and texts have one text everywhere; give others as text.
    """
    one = lambda c: F.coalesce(F.concat(F.octet_length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-1:"))
    row = F.conv(F.substring(F.md5(F.concat(*[one(c) for c in sorted(rows.columns)])), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest"))


def stale(now: DataFrame, stored: DataFrame) -> DataFrame:
    """(segment, stale) from two tables (segment, digest); a segment that was never stored is stale."""
    return now.join(stored.withColumnRenamed("digest", "_old"), "segment", "left").select("segment", (~F.col("digest").eqNullSafe(F.col("_old"))).alias("stale"))
