"""Project archives (a zip of a manifest and plans), and drawing exchange files of measured shapes."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names inside an archive, its version, and how much may be unpacked from one.
MANIFEST, PLANS, VERSION, MOST_BYTES, MOST_ENTRIES = "project.json", "plans/", "project.archive.v1", 2 << 30, 10_000
FIELDS = "status string, reason string, project_name string, takeoff string, plans array<string>"


def pack(takeoff: str, plans: dict[str, bytes], project_name: str = "") -> bytes:
    """An archive of a takeoff document (JSON text) and plans."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(MANIFEST, json.dumps({"schema": VERSION, "project_name": project_name, "plans": sorted(plans), "takeoff": json.loads(takeoff)}))
        for name, data in plans.items():
            z.writestr(zipfile.ZipInfo(PLANS + name), data)
    return out.getvalue()


def unpack(data: bytes) -> tuple:
    """(status, reason, project_name, takeoff, plans) of an archive; what isn't one, is of another version, or would unpack to too much is refused."""
    refused = lambda why: ("refused", why, None, None, None)
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return refused("not an archive")
    entries = z.infolist()
    if len(entries) > MOST_ENTRIES or sum(e.file_size for e in entries) > MOST_BYTES:
        return refused("too large unpacked")
    if MANIFEST not in z.namelist():
        return refused("no manifest")
    try:
        manifest = json.loads(z.read(MANIFEST))
    except ValueError:
        return refused("manifest is not JSON")
    if not isinstance(manifest, dict) or manifest.get("schema") != VERSION:
        return refused("another version")
    if not isinstance(manifest.get("takeoff"), dict):
        return refused("no takeoff")
    plans = sorted(e.filename.removeprefix(PLANS) for e in entries if e.filename.startswith(PLANS) and e.filename.lower().endswith(".pdf"))
    return "ok", None, str(manifest.get("project_name") or ""), json.dumps(manifest["takeoff"]), plans


def read_archives(files: DataFrame, content: str = "content") -> DataFrame:
    """Archives, as read by spark.read.format("binaryFile"), with their takeoff's JSON text and names of plans; refused ones say why."""
    rest = [c for c in files.columns if c != content]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields if f.name != content)

    def run(frames):
        for frame in frames:
            found = pd.DataFrame([unpack(bytes(c)) for c in frame[content]], columns=[f.split()[0] for f in FIELDS.split(", ")])
            yield pd.concat([frame[rest].reset_index(drop=True), found], axis=1)

    return files.mapInPandas(run, f"{kinds}, {FIELDS}")


def layer_name(tag: Column, suffix: str = "") -> Column:
    """A finish tag as a layer's name: what symbol names can't hold becomes a dash, upper case, at most 48 characters; no tag is UNTAGGED."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(tag, F.lit(""))), r'[<>/\\\\":;?*|,=`]+', "-"), r"\s+", " "), "-{2,}", "-")
    plain = F.upper(F.regexp_replace(plain, "^-|-$", ""))
    short = F.regexp_replace(F.substring(plain, 1, 48), "-$", "")
    return F.concat(F.lit("PL-"), F.when(plain == "", "UNTAGGED").otherwise(short), F.lit(f"-{suffix}" if suffix else ""))


def entities(shapes: DataFrame, conditions: DataFrame, sheets: DataFrame) -> DataFrame:
    """Entities (sheet_id, shape_id, kind, layer, closed, points in feet, y up) of measured shapes: rings and holes closed, runs open, counts circles; with status and reason:
    sheets without a scale, deducts that are holes already, and shapes of too few points are skipped."""
    frames = sheets.select(F.col("sheet_id").alias("of_sheet"), "width", "height", F.col("units_per_px").alias("upp"))
    tags = conditions.select(F.col("id").alias("of_condition"), "finish_tag")
    rows = shapes.join(frames, F.col("sheet_id") == F.col("of_sheet"), "left").join(tags, F.col("condition_id") == F.col("of_condition"), "left")
    role, n = F.col("measure_role"), F.size("verts_norm")
    reason = (
        F.when(~F.coalesce((F.col("upp") > 0) & (F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "sheet has no scale").when((role == "deduct") & F.col("cuts_shape_id").isNotNull(), "deduct is a hole of its parent")
        .when(n < F.when(role == "count", 1).when(role.isin("linear", "surface_area"), 2).otherwise(3), "too few points").when(~role.isin("floor_area", "deduct", "linear", "surface_area", "count"), "unknown role")
    )
    at = lambda ring: F.transform(ring, lambda p: F.array(p[0] * F.col("width") * F.col("upp"), (1 - p[1]) * F.col("height") * F.col("upp")))
    tag = F.col("finish_tag")
    layer = F.when(role == "count", layer_name(tag, "COUNT")).when(role == "linear", layer_name(tag, "LINEAR")).when(role == "surface_area", layer_name(tag, "WALL")).when(role == "deduct", layer_name(tag, "DEDUCT")).otherwise(layer_name(tag))
    kind = F.when(role == "count", "circle").otherwise("polyline")
    own = F.struct(kind.alias("kind"), layer.alias("layer"), role.isin("floor_area", "deduct").alias("closed"), at(F.col("verts_norm")).alias("points"))
    holes = F.transform(F.filter(F.coalesce("holes_norm", F.array().cast("array<array<array<double>>>")), lambda h: F.size(h) >= 3), lambda h: F.struct(F.lit("polyline").alias("kind"), layer_name(tag, "HOLE").alias("layer"), F.lit(True).alias("closed"), at(h).alias("points")))
    judged = rows.withColumn("reason", reason)
    listed = F.when(F.col("reason").isNull(), F.concat(F.array(own), F.when(role.isin("floor_area", "deduct"), holes).otherwise(F.slice(holes, 1, 0))))
    return judged.select("sheet_id", F.col("id").alias("shape_id"), F.explode_outer(listed).alias("e"), "reason").select("sheet_id", "shape_id", "e.kind", "e.layer", "e.closed", "e.points", F.when(F.col("reason").isNull(), "drawn").otherwise("skipped").alias("status"), "reason")


def exchange_text(rows: list, note: str = "measured shapes") -> str:
    """The text of a drawing exchange file of a sheet's entities (collected rows of entities()): a sheet's shapes, so the driver can write it."""
    out = ["999", note, "0", "SECTION", "2", "ENTITIES"]
    number = lambda v: f"{v:.4f}".rstrip("0").rstrip(".") or "0"
    for r in rows:
        if r["status"] != "drawn":
            continue
        if r["kind"] == "circle":
            x, y = r["points"][0]
            out += ["0", "CIRCLE", "8", r["layer"], "10", number(x), "20", number(y), "40", "0.5"]
        else:
            out += ["0", "LWPOLYLINE", "8", r["layer"], "90", str(len(r["points"])), "70", "1" if r["closed"] else "0"]
            for x, y in r["points"]:
                out += ["10", number(x), "20", number(y)]
    return "\n".join([*out, "0", "ENDSEC", "0", "EOF", ""])
