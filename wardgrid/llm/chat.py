"""Chat formatting by collapse of cumulative snapshots; DataFrame functions only.

A conversation is logged anew after each turn, so logs hold prefixes of longer logs. Each turn hashes its position,
role and text, with the length of the role before it, so that no other turn reads the same; running sums of two such hashes over
the turns give a hash of every prefix. A conversation whose whole hash is a proper prefix of another goes; of equal ones the least
conv_id stays. The rest is rendered. memberships() tells in which kept conversation each one went: the least conv_id of
those that it is a prefix of.

Turns are ordered by turn, then role, then text; only their order counts, not their numbers, and repeated rows count
as one turn. A null role or text counts as empty; rows without conv_id are left out. An empty table gives no rows. Markers that
stand in a role or a text are told from real ones by a backslash before their bar, as are such backslashes; line ends in a role
become spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _half(start: int) -> Column:
    """60 bits of the turn's hash as a decimal, so that sums cannot overflow."""
    turn = F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    return F.conv(F.substring(turn, start, 15), 16, 10).cast("decimal(38,0)")


def escaped(text: Column) -> Column:
    """text whose markers cannot be read as real ones."""
    return F.regexp_replace(text, r"<(\\*)\|im_", r"<$1\\|im_")


def rendered(role: Column, text: Column) -> Column:
    name = escaped(F.regexp_replace(role, r"[\r\n]+", " "))
    return F.concat(F.lit("<|im_start|>"), name, F.lit("\n"), escaped(text), F.lit("<|im_end|>\n"))


def _prefixes(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, their prefixes): a prefix is (conv_id, place, a, b, n_turns), its hash that of the turns up to place."""
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    prefixes = turns.withColumn("place", F.row_number().over(order)).withColumns({"a": F.sum(_half(1)).over(order), "b": F.sum(_half(16)).over(order)})
    return turns, prefixes.select("conv_id", "place", "a", "b").withColumn("n_turns", F.count("*").over(Window.partitionBy("conv_id")))


def _kept(per: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole, kept): distinct conversations (n_turns, a, b, conv_id, n_copies), and those that are no proper prefix."""
    whole = per.where("place = n_turns").groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = per.where("place < n_turns").select(F.col("place").alias("n_turns"), "a", "b").distinct()
    return whole, whole.join(proper, ["n_turns", "a", "b"], "left_anti")


def _homes(per: DataFrame, kept: DataFrame) -> DataFrame:
    """(n_turns, a, b, kept_id): every prefix of a kept conversation, whole ones too, with the least conv_id that has it."""
    of = per.join(kept.select("conv_id"), "conv_id", "left_semi")
    return of.groupBy(F.col("place").alias("n_turns"), "a", "b").agg(F.min("conv_id").alias("kept_id"))


def memberships(conversations: DataFrame) -> DataFrame:
    """(conv_id, kept_id): the kept conversation that each conversation is, or is a prefix of."""
    _, per = _prefixes(conversations)
    _, kept = _kept(per)
    return per.where("place = n_turns").join(_homes(per, kept), ["n_turns", "a", "b"]).select("conv_id", "kept_id")


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, n_prefixes, rendered): one row per maximal conversation. n_copies counts the conversations that
    are equal to it, n_prefixes those that are proper prefixes and have gone into it."""
    turns, per = _prefixes(conversations)
    whole, kept = _kept(per)
    gone = whole.join(_homes(per, kept), ["n_turns", "a", "b"]).where("conv_id <> kept_id").groupBy("kept_id").agg(F.sum("n_copies").alias("n_prefixes"))
    rows = kept.select("conv_id", "n_turns", "n_copies").join(gone.withColumnRenamed("kept_id", "conv_id"), "conv_id", "left")
    told = turns.join(rows, "conv_id").groupBy("conv_id", "n_turns", "n_copies", "n_prefixes").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: rendered(x["role"], x["text"])), "")
    return told.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.coalesce("n_prefixes", F.lit(0)).cast("long").alias("n_prefixes"), text.alias("rendered"))
