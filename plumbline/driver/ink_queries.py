"""Classes of lines over drawings laid out from the parts: each kind of ink planted once, among plain lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.driver.registry import query, table
from plumbline.operators import ink

_PART = "SELECT p_partkey AS id, p_partkey % 6 AS k, 6 + p_size % 15 AS n, 0.3 + (p_partkey % 4) * 0.2 AS pitch, p_size FROM part"


def drawings(spark, sf):
    """By k on a part's sheet: hatch of n lines at a pitch; a closed circle of n chords; a cloud of n scallops; a dimension string with n witness lines; a finish's outline
    in a heavier wall, and flecks; a box around a label. Every sheet has three plain lines. Ten px are a foot."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(key.alias("sheet_id"), (key % 6).alias("k"), (6 + size % 15).cast("int").alias("n"), ((0.3 + (key % 4) * 0.2) * 10).alias("pitch"))


def lines_of(found):
    n, k, pitch = F.col("n"), F.col("k"), F.col("pitch")

    def ln(x1, y1, x2, y2, pen=1, path=None, clip=False):
        d = lambda c: (c if hasattr(c, "cast") else F.lit(c)).cast("double")
        name = F.lit(None).cast("long") if path is None else (path if hasattr(path, "cast") else F.lit(path)).cast("long")
        return F.struct(d(x1).alias("x1"), d(y1).alias("y1"), d(x2).alias("x2"), d(y2).alias("y2"), F.lit(pen).alias("pen"), F.lit(clip).alias("clip"), F.lit(False).alias("fill"), name.alias("path"))

    steps = lambda count, f: F.transform(F.sequence(F.lit(0), (count if hasattr(count, "cast") else F.lit(count)).cast("int") - 1), f)
    plain = [ln(2000, 2000, 2300, 2000, 2), ln(2000, 2000, 2000, 2400, 2), ln(2300, 2150, 2300, 2400, 3), ln(5, 5, 6, 5, 1, None, True)]
    hatch = steps(n, lambda i: ln(0 + i * 2, i * pitch, 200 + i * 2, i * pitch))
    two_pi = 6.283185307179586
    circle = steps(2 * n, lambda i: ln(100 * F.cos(i / n * two_pi / 2), 100 * F.sin(i / n * two_pi / 2), 100 * F.cos((i + 1) / n * two_pi / 2), 100 * F.sin((i + 1) / n * two_pi / 2), 1))
    # scallops of eight chords each, half circles of radius 10 in a row
    cloud = steps(8 * n, lambda i: ln(F.floor(i / 8) * 20 - 10 * F.cos((i % 8) / 8 * two_pi / 2), -10 * F.sin((i % 8) / 8 * two_pi / 2), F.floor(i / 8) * 20 - 10 * F.cos((i % 8 + 1) / 8 * two_pi / 2), -10 * F.sin((i % 8 + 1) / 8 * two_pi / 2)))
    string = F.concat(F.array(ln(-3, 0, (n - 1) * 40 + 3, 0)), steps(n, lambda i: ln(i * 40, -3, i * 40, 8)), steps(n, lambda i: ln(i * 40 - 2, -2, i * 40 + 2, 2, 2)))
    ring = F.concat(F.array(ln(0, 0, 300, 0, 3), ln(20, 12, 280, 12, 1)), steps(n, lambda i: ln(1000 + i * 3, 1000, 1001 + i * 3, 1001, 1, i)))
    box = F.array(*[ln(*e, 1, 7) for e in ((500, 500, 530, 500), (530, 500, 530, 516), (530, 516, 500, 516), (500, 516, 500, 500))])
    every = F.concat(F.array(*plain), F.when(k == 0, hatch).when(k == 1, circle).when(k == 2, cloud).when(k == 3, string).when(k == 4, ring).otherwise(box))
    lines = found.select("sheet_id", F.posexplode(every).alias("idx", "s")).select("sheet_id", "idx", "s.*")
    texts = found.where("k = 5").select("sheet_id", F.lit(504.0).alias("x"), F.lit(513.0).alias("y"), F.lit(22.0).alias("w"), F.lit(10.0).alias("h"))
    return lines, texts


@query(
    "X28_ink_classes",
    f"WITH r AS ({_PART}), c AS (SELECT id, unnest(CASE k WHEN 0 THEN ['hatch'] WHEN 1 THEN ['circle'] WHEN 2 THEN ['cloud'] WHEN 3 THEN ['dimension'] WHEN 4 THEN ['ring', 'fleck'] ELSE ['tag box'] END) AS class, k, n FROM r) SELECT id AS sheet_id, class, CASE class WHEN 'hatch' THEN n - 2 WHEN 'circle' THEN 2 * n WHEN 'cloud' THEN 8 * n WHEN 'dimension' THEN 2 * n + 1 WHEN 'ring' THEN 1 WHEN 'fleck' THEN n ELSE 4 END AS lines FROM c UNION ALL SELECT id, 'clip', 1 FROM r UNION ALL SELECT id, 'plain', 3 + CASE k WHEN 0 THEN 2 WHEN 4 THEN 1 ELSE 0 END FROM r",
)
def x28(spark, sf):
    """Every line has one class; the outermost lines of a hatch, and walls, are plain."""
    found = drawings(spark, sf)
    lines, texts = lines_of(found)
    classes = ink.classify_lines(lines, texts, found.select("sheet_id", F.lit(10.0).alias("px_per_ft")))
    return classes.groupBy("sheet_id", "class").agg(F.count("*").alias("lines"))
