"""Mixing sources to target weights by Poisson replication, with built-in column functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources up to which their rates are broadcast (under 1 MB); beyond, an ordinary join that AQE splits on hot sources.
MOST_BROADCAST_SOURCES = 10_000
#: Rates above this are drawn as a sum of independent Poisson counts, each inverted in doubles: exp(-rate) is far from 0.
MOST_POISSON_RATE = 500.0


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) fixed by the seed and the parts: 52 bits of their MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson_table(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... as far as doubles tell it from 1 (rate at most MOST_POISSON_RATE)."""
    terms = F.sequence(F.lit(1), (rate + 12 * F.sqrt(rate) + 24).cast("int"))
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["cdf"], F.array(acc["sum"] + p)).alias("cdf"))

    return F.aggregate(terms, start, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, weights: DataFrame | None, size: float | None, default_weight: float = 1.0) -> DataFrame:
    """(mix_source, mix_rate, mix_parts, mix_cdf): the mean repeats of each source's rows that give its target share, and its draws.

    weights: (source, weight); None, and sources it lacks: default_weight. Weights that are null, NaN, infinite or
    negative count as 0. size: rows wanted in all; None: as many as docs has.
    """
    counts = docs.groupBy(F.col("source").alias("mix_source")).agg(F.count("*").alias("mix_rows"))
    if weights is None:
        weighed = counts.withColumn("mix_weight", F.lit(default_weight))
    else:
        given = weights.groupBy(F.col("source").alias("given_source")).agg(F.first("weight").cast("double").alias("mix_given"))
        weighed = counts.join(given, F.col("mix_source").eqNullSafe(F.col("given_source")), "left").withColumn("mix_weight", F.when(F.col("given_source").isNull() & F.col("mix_given").isNull(), F.lit(default_weight)).otherwise(F.col("mix_given")))
    weight = F.col("mix_weight")
    weighed = weighed.withColumn("mix_weight", F.when(weight.isNull() | F.isnan(weight) | (weight < 0) | (weight == float("inf")), 0.0).otherwise(weight))
    all_weight, all_rows = weighed.agg(F.sum("mix_weight"), F.sum("mix_rows")).first()
    wanted = float((all_rows or 0) if size is None else size)
    rate = F.col("mix_weight") / F.lit(all_weight) * F.lit(wanted) / F.col("mix_rows") if all_weight else F.lit(0.0)
    parts = F.greatest(F.lit(1), F.ceil(rate / MOST_POISSON_RATE)).cast("long")
    return weighed.select("mix_source", rate.alias("mix_rate"), parts.alias("mix_parts"), poisson_table(rate / parts).alias("mix_cdf"))


def replicate(docs: DataFrame, weights: DataFrame | None = None, size: float | None = None, seed: int = 7, copy_column: str | None = "copy", default_weight: float = 1.0) -> DataFrame:
    """Each row repeated by a Poisson count of its source's rate, in a global random order.

    The count inverts the Poisson distribution at a number hashed from seed and doc_id (of a rate above MOST_POISSON_RATE:
    the sum of equal parts, each at a number of its own), so it doesn't depend on how rows
    lie in partitions; equal rows of one doc_id get equal counts, a null doc_id counts as an id of its own. Null sources
    are a source. copy_column gets the copy's number from 1 (replacing a column of that name); None: no such column.
    A source of weight 0 goes; if all weights are 0, or docs is empty, the result is empty. Other columns are kept.
    """
    table = rates(docs, weights, size, default_weight)
    sources = table.sparkSession.createDataFrame(table.limit(MOST_BROADCAST_SOURCES + 1).collect(), table.schema)
    if sources.count() <= MOST_BROADCAST_SOURCES:
        table = F.broadcast(sources)
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("mix_row"), F.col("source").alias("mix_key"), F.col("doc_id").alias("mix_id"))
    joined = row.join(table, F.col("mix_key").eqNullSafe(F.col("mix_source")))
    below = lambda u: F.size(F.filter("mix_cdf", lambda c: c < u)).cast("long")
    further = F.when(F.col("mix_parts") > 1, F.sequence(F.lit(1).cast("long"), F.col("mix_parts") - 1))  # the parts after the first
    rest = F.coalesce(F.aggregate(further, F.lit(0).cast("long"), lambda acc, k: acc + below(uniform(seed, F.col("mix_id"), k))), F.lit(0))
    counted = joined.select("mix_row", "mix_id", (below(uniform(seed, F.col("mix_id"))) + rest).alias("mix_n")).where("mix_n > 0")
    copies = counted.select("mix_row", "mix_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_n"))).alias("mix_copy"))
    place = F.xxhash64(F.lit(seed), "mix_id", "mix_copy")
    shuffled = copies.withColumn("mix_place", place).repartition("mix_place").sortWithinPartitions("mix_place")
    kept = [F.col("mix_row").getField(n).alias(n) for n in names if n != copy_column]
    return shuffled.select(*kept, *([F.col("mix_copy").alias(copy_column)] if copy_column else []))
