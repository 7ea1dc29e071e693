"""Project documents in JSON, and reports as CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.keys import csv_cell
from plumbline.plans.ranking import numbered

COMPUTED = "struct<area_sf:double,perimeter_lf:double,count:double>"
MATERIAL = "struct<id:string,name:string,per:double,basis:string,unit:string,round:boolean,note:string>"
DOCUMENT = (
    "schema string, project_name string, units string, sheets array<struct<sheet_id:string,units_per_px:double,scale_source:string,scale_confirmed:boolean>>, "
    f"conditions array<struct<id:string,finish_tag:string,multiplier:double,waste_pct:double,height_ft:double,thickness_in:double,materials:array<{MATERIAL}>>>, "
    f"shapes array<struct<id:string,sheet_id:string,condition_id:string,measure_role:string,verts_norm:array<array<double>>,height_ft:double,label:string,author:string,cuts_shape_id:string,computed:{COMPUTED},created_at:string,updated_at:string>>"
)


def read_documents(spark: SparkSession, path: str, tag_prefix: str = "") -> DataFrame:
    """Project documents, one for each file, with project_id from the path; documents of another schema are refused by name."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("project_id", F.col("_metadata.file_name"))
    known = F.col("schema").startswith(tag_prefix) if tag_prefix else F.col("schema").isNotNull()
    return docs.withColumn("status", F.when(known, "ok").otherwise("refused")).withColumn("reason", F.when(~F.coalesce(known, F.lit(False)), "not a project document"))


def parse_documents(texts: DataFrame, column: str = "document", tag_prefix: str = "") -> DataFrame:
    """Documents held as text: their members beside the other columns, with status and reason: text that is no document of the schema is refused."""
    parsed = texts.withColumn("d", F.from_json(column, DOCUMENT))
    known = F.coalesce(F.col("d.schema").startswith(tag_prefix) if tag_prefix else F.col("d.schema").isNotNull(), F.lit(False))
    rest = [c for c in texts.columns if c != column]
    return parsed.select(*rest, "d.*", F.when(known, "ok").otherwise("refused").alias("status"), F.when(~known, "not a project document").alias("reason"))


def exploded(docs: DataFrame, member: str) -> DataFrame:
    """One member's records with project_id and their place (ord)."""
    return docs.where("status = 'ok'").select("project_id", F.posexplode(member).alias("ord", "r")).select("project_id", "ord", "r.*")


def csv_lines(rows: DataFrame, columns: list[tuple[str, str, bool]], order: list[str]) -> DataFrame:
    """(place, line) of a CSV section: columns are (name, header, is text)."""
    header = rows.sparkSession.createDataFrame([(0, ",".join(h for _, h, _ in columns))], "place long, line string")
    cells = F.concat_ws(",", *[csv_cell(F.col(c), text) for c, _, text in columns])
    body = numbered(rows.select(cells.alias("line"), *[F.col(c).alias(f"by_{i}") for i, c in enumerate(order)]), "place", *[f"by_{i}" for i in range(len(order))])
    return header.unionByName(body.select("place", "line"))


def report_json(conditions: DataFrame, totals: DataFrame, materials: DataFrame) -> DataFrame:
    """A report of one row: its sections as ordered arrays in one JSON text. Sections are condition rows, so their size is a project's."""
    listed = lambda df, order: df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*df.columns).alias("r")))), lambda s: s["r"]).alias("rows"))
    a, b, c = listed(conditions, ["ord"]).withColumnRenamed("rows", "conditions"), totals.select(F.struct(*totals.columns).alias("totals")), listed(materials, ["name", "unit"]).withColumnRenamed("rows", "materials")
    one = a.join(b, F.lit(True)).join(c, F.lit(True))
    return one.select(F.to_json(F.struct(F.lit("report.v1").alias("schema"), "conditions", "totals", "materials")).alias("report"))


def write_guarded(df: DataFrame, path: str, marker: str = "_plumbline") -> None:
    """Overwrites a folder only if an earlier export of this library made it.

    The data are written beside it with the marker among them, the old folder is moved aside, and the new one takes its place: a crash leaves the old export, the
    new one, or the old one aside, which the next call puts back first. A rename that fails is an error, and nothing is deleted before it.
    """
    spark = df.sparkSession
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, fresh, old = (path_of(f"{path.rstrip('/')}{end}") for end in ("", ".new", ".old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target) and fs.exists(path_of(old, marker)) and not fs.rename(old, target):
        raise OSError(f"{old} can't be put back")
    if fs.exists(target) and not fs.exists(path_of(target, marker)):
        raise FileExistsError(f"{path} wasn't written by an export; it stays as it is")
    df.write.mode("overwrite").parquet(fresh.toString())
    fs.create(path_of(fresh, marker)).close()
    if fs.exists(path_of(old, marker)):
        fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{target} can't be moved aside")
    if not fs.rename(fresh, target):
        raise OSError(f"{fresh} can't become {target}")
    if fs.exists(path_of(old, marker)):
        fs.delete(old, True)
