"""Alignment of timed streams to stays, without letting later knowledge in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.operators.timegrid import HOUR, micros


def bind(stream: DataFrame, stays: DataFrame) -> DataFrame:
    """Rows bound to a stay join that stay alone; the others join every stay of their patient."""
    at = stays.select("stay_id", "patient_id", "intime", *[c for c in ("hadm_id", "outtime") if c in stays.columns])
    own = stream.where("bound_stay_id is not null").withColumnRenamed("bound_stay_id", "stay_id").drop("patient_id").join(at, "stay_id")
    free = stream.where("bound_stay_id is null").drop("bound_stay_id").join(at, "patient_id")
    return own.unionByName(free, allowMissingColumns=True)


def hours_since(t: str, origin: str = "intime") -> Column:
    return (micros(t) - micros(origin)) / F.lit(HOUR)


def ranked(aligned: DataFrame) -> DataFrame:
    """Adds prior_visit_idx: the rank of the source admission within the stay, by the time from which it can be known."""
    first = F.min("knowable_time").over(Window.partitionBy("stay_id", "source_admission_id"))
    return aligned.withColumn("_first", first).withColumn("prior_visit_idx", F.dense_rank().over(Window.partitionBy("stay_id").orderBy("_first")) - 1).drop("_first")


def align_diagnoses(stream: DataFrame, stays: DataFrame) -> DataFrame:
    """Codes known at admission."""
    known = bind(stream, stays).where("knowable_time <= intime").withColumn("delta_h", hours_since("knowable_time"))
    return ranked(known).select("stay_id", "code", "code_system", "origin", "delta_h", "prior_visit_idx")


def align_notes(stream: DataFrame, stays: DataFrame, discharge: str = "discharge_summary") -> DataFrame:
    """Notes from before admission, or inside the stay unless they sum it up; never the discharge note of its own admission."""
    own = F.coalesce(F.col("source_admission_id") == F.col("hadm_id"), F.lit(False)) & (F.col("note_type") == discharge)
    inside = (F.col("knowable_time") >= F.col("intime")) & (F.col("knowable_time") <= F.col("outtime"))
    met = bind(stream.withColumnRenamed("hadm_id", "_note_hadm") if "hadm_id" in stream.columns else stream, stays)
    kept = met.where(((F.col("knowable_time") < F.col("intime")) | (inside & (F.col("note_type") != discharge))) & ~own)
    return ranked(kept.withColumn("delta_h_signed", hours_since("knowable_time")).withColumn("within_window", F.col("knowable_time") >= F.col("intime")))


def align_treatments(stream: DataFrame, stays: DataFrame, before: int = 720, after: int = 168) -> DataFrame:
    """Treatments from 30 days before admission to 7 days after, with the hour of their end."""
    met = bind(stream, stays).withColumn("delta_h", hours_since("start_time")).withColumn("end_delta_h", hours_since("end_time"))
    return ranked(met.where(F.col("delta_h").between(-before, after)))


def visible(grid: DataFrame, notes: DataFrame) -> DataFrame:
    """Each hour with the notes known by then."""
    return grid.join(notes, "stay_id").where("delta_h_signed <= hour")
