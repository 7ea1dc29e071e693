"""Commands on records, as new versions of their tables: what they change, and what they refuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_edits(shapes: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """Shapes after edits (id, op, fields): a shape that a person reviewed is ink, and refuses to be edited or deleted.

    outcome: untouched, edited, deleted or refused; deleted rows stay with their outcome.
    """
    asked = edits.select(F.col("id").alias("e_id"), F.col("op").alias("e_op"), *[F.col(f).alias(f"e_{f}") for f in fields])
    joined = shapes.join(asked, F.col("id") == F.col("e_id"), "left")
    ink = F.coalesce(F.col("reviewed"), F.lit(False))
    outcome = F.when(F.col("e_id").isNull(), "untouched").when(ink, "refused").when(F.col("e_op") == "delete", "deleted").otherwise("edited")
    joined = joined.withColumn("outcome", outcome)
    new = [F.when(F.col("outcome") == "edited", F.coalesce(f"e_{f}", f)).otherwise(F.col(f)).alias(f) for f in fields]
    return joined.select(*[c for c in shapes.columns if c not in fields], *new, "outcome")


def accept_proposals(conditions: DataFrame, proposals: DataFrame, fields: list[str]) -> DataFrame:
    """Conditions with the fields that accepted edit proposals state; what they leave out stays."""
    stated = proposals.where("accepted").groupBy(F.col("condition_id").alias("p_id")).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"p_{f}") for f in fields])
    joined = conditions.join(stated, F.col("id") == F.col("p_id"), "left")
    return joined.select(*[c for c in conditions.columns if c not in fields], *[F.coalesce(f"p_{f}", f).alias(f) for f in fields])


def one_verdict_each(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New verdicts with whether they stand: a shape has one at a time, the first of several wins."""
    first = new.groupBy("shape_id").agg(F.min("seq").alias("first_seq"))
    taken = existing.select(F.col("shape_id").alias("taken")).distinct()
    joined = new.join(first, "shape_id").join(taken, F.col("shape_id") == F.col("taken"), "left")
    return joined.select("shape_id", "seq", F.when(F.col("taken").isNotNull(), "refused").when(F.col("seq") > F.col("first_seq"), "refused").otherwise("marked").alias("outcome"))


def renamed(label: Column, old: str, new: str) -> Column:
    return F.when(F.trim(label) == old, F.lit(new)).otherwise(label)


def normalised_review(reviewed: Column, actor: Column) -> Column:
    """Old agent work without a review flag is pending; a person's work without one stays as recorded."""
    return F.when(reviewed.isNull() & (actor == "agent"), F.lit(False)).otherwise(reviewed)


def edit_materials(materials: Column, remove: Column, add: Column) -> Column:
    """An array of material names without one, with another at its end; nulls change nothing."""
    less = F.when(remove.isNull(), materials).otherwise(F.array_remove(materials, remove))
    return F.when(add.isNull(), less).otherwise(F.concat(less, F.array(add)))


def recalibrated(shapes: DataFrame, scales: DataFrame) -> DataFrame:
    """Shapes of rescaled sheets with areas and lengths to the new scale, counts as they are; a sheet with reviewed shapes is refused as a whole."""
    ink = shapes.where(F.coalesce(F.col("reviewed"), F.lit(False))).select(F.col("sheet_id").alias("ink_sheet")).distinct()
    s = scales.select(F.col("sheet_id").alias("scale_sheet"), (F.col("new_upp") / F.col("old_upp")).alias("ratio"))
    joined = shapes.join(s, F.col("sheet_id") == F.col("scale_sheet"), "left").join(ink, F.col("sheet_id") == F.col("ink_sheet"), "left")
    outcome = F.when(F.col("ratio").isNull(), "untouched").when(F.col("ink_sheet").isNotNull(), "refused").when(F.col("measure_role") == "count", "untouched").otherwise("repriced")
    joined = joined.withColumn("outcome", outcome)
    factor = F.when(F.col("outcome") == "repriced", F.col("ratio")).otherwise(F.lit(1.0))
    return joined.select("id", "sheet_id", "measure_role", (F.col("area_sf") * factor * factor).alias("area_sf"), (F.col("perimeter_lf") * factor).alias("perimeter_lf"), "outcome")


def scope_merge(pairs: DataFrame) -> DataFrame:
    """What becomes of two overlapping floors: the reviewed side wins, nearly whole losers go, others are trimmed; two reviewed sides, or none, are left to a person."""
    a, b = F.coalesce(F.col("a_reviewed"), F.lit(False)), F.coalesce(F.col("b_reviewed"), F.lit(False))
    action = F.when(a & b, "refused").when(~a & ~b, "undecided").when(F.col("loser_share") >= 0.98, "delete").otherwise("trim")
    winner = F.when(a & ~b, F.col("a_id")).when(b & ~a, F.col("b_id"))
    return pairs.select("a_id", "b_id", action.alias("action"), winner.alias("winner"))
