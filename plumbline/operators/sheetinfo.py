"""What a sheet says of itself: its number, discipline, drawing scales, title block, revisions, callouts.

A sheet is one page's text and lines, so it is judged by one call; sheets are judged in parallel.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import scale_patterns
from plumbline.operators.tables import SPANS, Span, revision_of, spans_of
from plumbline.plans.scratch import kept, sheetwise

# Form of sheet numbers and of the field that names them; paper sizes; where a title block lies, as shares of a sheet.
SHEET_NUMBER, PAPER, NUMBER_FIELD = re.compile(r"[A-Z]{1,3}[-. ]?\d{1,5}(?:[-.]\d{1,4}){0,2}[A-Z]?"), re.compile("A[0-4]"), re.compile(r"TEGN(?:INGS?)?\.?NR\.?|TEGNINGSNUMMER|SHEET(?:NO\.?|NUMBER|#)?|DWG\.?NO\.?|DRAWING(?:NO\.?|NUMBER)")
BLOCK_X, BLOCK_Y, FRAME_SHARE = 0.60, 0.55, 0.2
# Words by which titles, legends and numbers name a discipline, in order; what makes a trade's word a room's name.
ARCHITECTURE = re.compile(r"\b(BRANNTEGNING|PLANTEGNING|FLOOR PLAN|ARKITEKT\w*|MØBLERINGSPLAN|FURNITURE PLAN)\b")
TRADES = [
    ("demolition", re.compile(r"\b(RIVING|RIVEPLAN|RIVNINGSPLAN|DEMOLITION|DEMO PLAN)\b")), ("mechanical", re.compile(r"\b(VENTILASJON\w*|LUFTBEHANDLING|KANALPLAN|HVAC|MECHANICAL|DUCTWORK|SHEET METAL|OPPVARMING|KJØLING|VARMEANLEGG|VVS\w*)\b")),
    ("plumbing", re.compile(r"\b(SANITÆR\w*|RØRANLEGG|VANNFORSYNING|AVLØP\w*|PLUMBING|DOMESTIC WATER|SANITARY)\b")), ("fire_protection", re.compile(r"\b(SPRINKLER\w*|FIRE PROTECTION|FIRE SUPPRESSION)\b")),
    ("electrical", re.compile(r"\b(ELKRAFT|ELEKTRO\w*|EKOM|SVAKSTRØM|BELYSNING\w*|ELECTRICAL|LIGHTING|POWER PLAN|LOW VOLTAGE)\b")), ("structural", re.compile(r"\b(BÆRESYSTEM|FUNDAMENT\w*|ARMERING\w*|DEKKE OVER|STRUCTURAL|FRAMING PLAN|FOUNDATION PLAN)\b")),
    ("civil_landscape", re.compile(r"\b(LANDSKAP\w*|UTOMHUS\w*|SITUASJONSPLAN|VA-?PLAN|GRAVEPLAN|CIVIL|SITE PLAN|GRADING|LANDSCAPE)\b")),
]
ROOM_AFTER, ROOM_ENDING = re.compile(r"\s*(ROOM|RM|CLOSET|CL|SHAFT|SPACE|YARD|SJAKT|ROM|SENTRAL|RAPPORT)\b"), re.compile("(ROM|ROMMET|SENTRAL|SENTRALEN|SJAKT|SKAP)$")
LEGENDS = [
    ("electrical", ["STIKKONTAKT", "LYSBRYTER", "BRYTER", "LYSPUNKT", "ARMATUR", "UTELYS", "UTTAK", "KABELKANAL", "RECEPTACLE", "SWITCH", "LUMINAIRE", "PANELBOARD", "JUNCTION"]), ("mechanical", ["TILLUFT", "AVTREKK", "SPJELD", "AGGREGAT", "DIFFUSER", "DAMPER", "GRILLE", "SUPPLY", "EXHAUST", "THERMOSTAT"]),
    ("plumbing", ["SLUK", "STAKEKUMMER", "VANNLÅS", "CLEANOUT", "HOSE", "BACKFLOW", "WATER HEATER"]),
]
CODES = {"ARK": "architectural", "IARK": "architectural", "A": "architectural", "I": "architectural", "RIV": "mechanical", "VVS": "mechanical", "M": "mechanical", "H": "mechanical", "P": "plumbing", "RØR": "plumbing", "RIE": "electrical", "EL": "electrical", "E": "electrical", "FP": "fire_protection", "SPR": "fire_protection", "RIB": "structural", "S": "structural", "K": "structural", "LARK": "civil_landscape", "L": "civil_landscape", "C": "civil_landscape"}
HEADINGS = re.compile(r"(NOTES?|NOTER|MERKNAD\w*|LEGEND|TEGNFORKLARING)\b|\bGENERAL\b")
SCALE_WORD = re.compile(r"SCALE|MÅLESTOKK|MÅLESTOK|MÅL\b|SKALA|M\s*=", re.I)
CALLOUT = r"^([0-9]{1,2})\s*/\s*([A-Z]{1,2}-?[0-9]{1,3}(?:\.[0-9]+)?)$"
# How far around a measured box a scale note counts, as shares of it, and how far its scale may differ.
NOTE_BESIDE, NOTE_BELOW, SCALE_TOLERANCE = 0.10, 0.35, 0.05


def sheet_number(spans: list[Span], width: float, height: float) -> str | None:
    """The sheet's number from its lower right: single pieces of text and pieces joined along a line; beside a field that names it
    before any other, then the largest and furthest into the corner. Paper sizes and tags repeated on the drawing aren't it."""
    plain = lambda s: re.sub(r"\s+", "", s.text.upper())
    block = [s for s in spans if s.text.strip() and s.x >= width * BLOCK_X and s.y >= height * BLOCK_Y]
    inside = {id(s) for s in block}
    elsewhere: dict[str, int] = {}
    for s in spans:
        if id(s) not in inside:
            elsewhere[plain(s)] = elsewhere.get(plain(s), 0) + 1
    fields = [s for s in block if NUMBER_FIELD.fullmatch(plain(s).removesuffix(":"))]
    candidates = [(plain(s), s.x, s.y, s.h) for s in block]
    line: list[Span] = []
    lines: list[list[Span]] = []
    for s in sorted(block, key=lambda s: (s.y, s.x)):
        if not line or abs(s.y - line[0].y) > max(2, line[0].h * 0.35):
            line = []
            lines.append(line)
        line.append(s)
    for line in lines:
        run: list[Span] = []
        for s in [*sorted(line, key=lambda s: s.x), None]:
            if run and (s is None or s.x - (run[-1].x + run[-1].w) > 1.2 * max(r.h for r in run)):
                if len(run) > 1:
                    candidates.append(("".join(map(plain, run)), run[0].x, run[0].y, max(r.h for r in run)))
                run = []
            if s is not None:
                run.append(s)
    ranked = []
    for place, (text, x, y, h) in enumerate(candidates):
        if 2 <= len(text) <= 12 and SHEET_NUMBER.fullmatch(text) and not PAPER.fullmatch(text) and elsewhere.get(text, 0) < 2:
            beside = any(-1.5 * f.h <= y - f.y <= 4.5 * f.h and f.x - 2 * f.h <= x <= f.x + f.w + 6 * f.h for f in fields)
            ranked.append((beside, h + 4 * x / width + 4 * y / height, -place, text))
    return max(ranked)[3] if ranked else None


def discipline(spans: list[Span], width: float, height: float, number: str | None = None) -> tuple[str, str | None, str | None]:
    """(discipline, evidence, source): a trade that a title names, before plan words; then a legend of three of its devices; then the
    code in the sheet's number; else unknown. Titles are short lines in the title block of at least the running text's size."""
    tall = lambda s: s.h
    in_corner = lambda s: s.middle >= width * 0.6 and s.y + s.h / 2 >= height * 0.7
    zone = [s for s in spans if in_corner(s) or s.middle >= width * 0.85]
    outside = sorted(tall(s) for s in spans if not (in_corner(s) or s.middle >= width * 0.85) and tall(s) > 0)
    every = sorted(tall(s) for s in spans if tall(s) > 0)
    running = (outside if len(outside) >= 20 else every or [0])[len(outside if len(outside) >= 20 else every or [0]) // 2]
    small = outside[len(outside) // 4] if len(outside) >= 20 else running
    large = [s for s in zone if len(outside) < 5 or tall(s) >= (small if in_corner(s) else 1.25 * running)]
    plans = None
    for s in sorted(large, key=lambda s: -tall(s))[:40]:
        t = " ".join(re.sub(r"\([^)]*\)", " ", s.text).upper().split())
        if not t or len(t) > 60 or t.endswith(":") or re.search("[,;]", t) or len(t.split(" ")) > 6 or HEADINGS.search(t):
            continue
        for name, words in TRADES:
            if any(not ROOM_ENDING.search(m[0]) and not ROOM_AFTER.match(t[m.end() :]) for m in words.finditer(t)):
                return name, s.text.strip(), "title"
        if plans is None and ARCHITECTURE.search(t):
            plans = s.text.strip()
    if plans:
        return "architectural", plans, "title"
    words = {w for s in zone if tall(s) >= small for w in re.split("[^A-ZÆØÅ]+", s.text.upper()) if w}
    for name, devices in LEGENDS:
        hits = [d for d in devices if any(w.startswith(d) for w in words)]
        if len(hits) >= 3:
            return name, "legend: " + ", ".join(hits).lower(), "title"
    u = " ".join((number or "").upper().split())
    code = re.search("(?:^|[^A-ZÆØÅ])(ARK|IARK|LARK|RIV|RIE|RIB|VVS|RØR)(?:[^A-ZÆØÅ]|$)", u) or re.fullmatch(r"([A-Z]{1,2})-?(?:\d{3,4}|\d{1,2}\.\d{1,2})[A-Z]?", u)
    if code and code[1] in CODES:
        return CODES[code[1]], u, "number"
    return "unknown", None, None


_SCALES = None


@lru_cache(1 << 12)
def scales_in(text: str) -> list[tuple[str, float]]:
    """Standard scales (label, feet per pixel) that a text states."""
    global _SCALES
    if _SCALES is None:
        _SCALES = [(label, upp, re.compile(pattern)) for _, label, upp, pattern in scale_patterns()]
    straight = re.sub("[‘’′]", "'", re.sub("[“”″]", '"', text)).upper()
    canon = "".join("|" if re.fullmatch("(?:ISO-?)?A[0-4]", w) else re.sub("^(?:ISO-?)?A[0-4]/", "|", w) for w in straight.split())
    return [(label, upp) for label, upp, form in _SCALES if form.search(canon)]


def view_scales(spans: list[Span], width: float, height: float) -> list[tuple[int, str, float]]:
    """(ord, label, feet per pixel) of the scale notes of a sheet's views: outside the title block, one scale stated, and titled: by a
    word for scale in it, or beside it, or beside larger text. A bare ratio amid a plan is a slope."""
    heights = sorted(s.h for s in spans if s.h > 0)
    usual = heights[len(heights) // 2] if heights else 0.0
    out = []
    for s in spans:
        cx, cy = s.middle, s.y + s.h / 2
        found = scales_in(s.text)
        if len(found) != 1 or cx >= width * 0.82 or (cx >= width * 0.55 and cy >= height * 0.8):
            continue
        h = max(1.0, s.h)
        near = lambda o: abs(o.y + o.h / 2 - cy) <= 3 * h and abs(o.middle - cx) <= 25 * h  # noqa: E731,B023
        if SCALE_WORD.search(s.text) or any(o is not s and near(o) and (SCALE_WORD.search(o.text) or o.h >= 1.3 * usual) for o in spans):
            out.append((s.ord, *found[0]))
    return out


INFO = "sheet_id long, sheet_number string, discipline string, evidence string, source string"
VIEWS = "sheet_id long, ord long, label string, units_per_px double"


def _sheets(spans: DataFrame, sheets: DataFrame) -> DataFrame:
    size = sheets.select(F.col("sheet_id").alias("of_sheet"), "width", "height")
    return spans.select("sheet_id", *SPANS).join(size, F.col("sheet_id") == F.col("of_sheet")).drop("of_sheet")


def sheet_info(spans: DataFrame, sheets: DataFrame) -> DataFrame:
    """(sheet_id, sheet_number, discipline, evidence, source) of sheets (sheet_id, width, height) with text."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found, w, h = spans_of(frame), float(frame["width"].iloc[0]), float(frame["height"].iloc[0])
        number = sheet_number(found, w, h)
        return pd.DataFrame([(frame["sheet_id"].iloc[0], number, *discipline(found, w, h, number))], columns=[c.split()[0] for c in INFO.split(", ")])

    return sheetwise(_sheets(spans, sheets), run, INFO, "sheet_id")


def view_scale_labels(spans: DataFrame, sheets: DataFrame) -> DataFrame:
    """The scale notes of all sheets' views."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = view_scales(spans_of(frame), float(frame["width"].iloc[0]), float(frame["height"].iloc[0]))
        return pd.DataFrame([(frame["sheet_id"].iloc[0], *x) for x in found], columns=[c.split()[0] for c in VIEWS.split(", ")])

    return sheetwise(_sheets(spans, sheets), run, VIEWS, "sheet_id")


def mixed_scales(measured: DataFrame, notes: DataFrame) -> DataFrame:
    """Measured regions (sheet_id, id, x0, y0, x1, y1, units_per_px) with the scale note (sheet_id, x, y, label, units_per_px) in or just
    below them that disagrees with their scale: only where one scale is noted there."""
    from plumbline.operators.grid import meeting

    notes = kept(notes)  # read several times, and dear where sheets are read for them
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    wide = measured.select("sheet_id", "id", "units_per_px", (F.col("x0") - w * NOTE_BESIDE).alias("x0"), (F.col("y0") - h * NOTE_BESIDE).alias("y0"), (F.col("x1") + w * NOTE_BESIDE).alias("x1"), (F.col("y1") + h * NOTE_BELOW).alias("y1"))
    at = notes.select("sheet_id", "label", F.col("units_per_px").alias("noted"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    found = meeting(wide.where("units_per_px > 0"), at).groupBy(F.col("a.id").alias("id")).agg(F.count_distinct("b.label").alias("n"), F.min("b.label").alias("label"), F.min("b.noted").alias("noted"), F.first("a.units_per_px").alias("upp"))
    return found.where((F.col("n") == 1) & (F.abs(F.col("noted") - F.col("upp")) / F.col("upp") > SCALE_TOLERANCE)).select("id", "label", F.col("noted").alias("noted_upp"), F.col("upp").alias("adopted_upp"))


def title_block(title: tuple, segments: np.ndarray, width: float, height: float) -> tuple:
    """The box of a title block: from its title's box left to the nearest tall upright rule, pieces of one rule joined, and out to the
    sheet's right edge; the title's own box without such a rule."""
    middle = (title[1] + title[3]) / 2
    x = (segments[:, 0] + segments[:, 2]) / 2
    upright = (np.abs(segments[:, 2] - segments[:, 0]) <= 1) & (segments[:, 1] != segments[:, 3]) & (x <= title[0]) & (x >= width * BLOCK_X * 0.9)
    at, top, bottom = np.round(x[upright]), segments[upright][:, [1, 3]].min(1), segments[upright][:, [1, 3]].max(1)
    for column in np.unique(at)[::-1]:
        mine = np.flatnonzero(at == column)
        mine = mine[np.argsort(top[mine], kind="stable")]
        reach = np.maximum.accumulate(bottom[mine])
        starts = np.append(True, top[mine][1:] > reach[:-1] + 2)
        for a, b in zip(np.flatnonzero(starts), np.append(np.flatnonzero(starts)[1:], len(mine))):
            y0, y1 = top[mine[a]], bottom[mine[a:b]].max()
            if y0 <= middle <= y1 and y1 - y0 >= FRAME_SHARE * height:
                return float(x[upright][mine].max()), float(y0), width, float(y1)
    return title


def title_blocks(titles: DataFrame, segments: DataFrame, sheets: DataFrame) -> DataFrame:
    """(sheet_id, x0, y0, x1, y1) of the title blocks of sheets (sheet_id, width, height) whose title (sheet_id, x0, y0, x1, y1) lies in
    the title zone; segments: (sheet_id, x1, y1, x2, y2). Only upright rules travel."""
    zone = titles.join(sheets.select(F.col("sheet_id").alias("of_sheet"), "width", "height"), F.col("sheet_id") == F.col("of_sheet")).drop("of_sheet")
    zone = zone.where(((F.col("x0") + F.col("x1")) / 2 >= F.col("width") * BLOCK_X) & ((F.col("y0") + F.col("y1")) / 2 >= F.col("height") * BLOCK_Y))
    rules = segments.where((F.abs(F.col("x2") - F.col("x1")) <= 1) & (F.col("y1") != F.col("y2"))).groupBy(F.col("sheet_id").alias("of_sheet")).agg(F.collect_list(F.array("x1", "y1", "x2", "y2")).alias("rules"))

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                lines = np.array([list(s) for s in r.rules], float).reshape(-1, 4) if r.rules is not None else np.zeros((0, 4))
                out.append((r.sheet_id, *title_block((r.x0, r.y0, r.x1, r.y1), lines, r.width, r.height)))
            yield pd.DataFrame(out, columns=["sheet_id", "x0", "y0", "x1", "y1"])

    joined = zone.join(rules, F.col("sheet_id") == F.col("of_sheet"), "left").select("sheet_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "width", "height")], "rules")
    return joined.mapInPandas(run, "sheet_id long, x0 double, y0 double, x1 double, y1 double")


def callouts(spans: DataFrame) -> DataFrame:
    """Detail callouts such as 3/A-601: (sheet_id, ord, detail, target_sheet)."""
    t = F.trim("str")
    return spans.where(t.rlike(CALLOUT)).select("sheet_id", "ord", F.regexp_extract(t, CALLOUT, 1).alias("detail"), F.regexp_extract(t, CALLOUT, 2).alias("target_sheet"))


def revision_mark(text: Column) -> Column:
    """The revision that a whole piece of text marks, a delta or REV and its number; null for any other."""
    t = F.upper(F.regexp_replace(F.trim(text), r"\s+", " "))
    before, after, rev = r"^[Δ∆△▲] ?([0-9]{1,2}[A-Z]?)$", r"^([0-9]{1,2}[A-Z]?) ?[Δ∆△▲]$", r"^REV(?:ISION)?\.? ?#? ?([0-9]{1,2}[A-Z]?)$"
    found = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (before, after, rev)])
    return F.when(F.length(t) <= 12, found)


def drawn_delta(digit: Span, segments: np.ndarray) -> tuple | None:
    """The box of the smallest triangle of three of a sheet's segments that closes around a digit: sides 1.2 to 8 heights, the longest at
    most 2.5 times the shortest. Dense linework (over 60 segments near) isn't read."""
    h = max(digit.h or 8.0, 6.0)
    centre = np.array([digit.middle, digit.y + h / 2])
    long = np.hypot(segments[:, 2] - segments[:, 0], segments[:, 3] - segments[:, 1])
    away = np.hypot((segments[:, 0] + segments[:, 2]) / 2 - centre[0], (segments[:, 1] + segments[:, 3]) / 2 - centre[1])
    near = segments[(away <= 5 * h) & (long >= max(4, 1.2 * h)) & (long <= min(400, 8 * h))]
    if not 3 <= len(near) <= 60:
        return None
    reach = max(2.0, 0.35 * h)
    ends = near.reshape(-1, 2, 2)
    best = None
    for trio in combinations(range(len(near)), 3):
        p = ends[list(trio)]
        for b in ((0, 1), (1, 0)):
            for c in ((0, 1), (1, 0)):
                chain = np.array([p[0], p[1][list(b)], p[2][list(c)]])
                if (np.hypot(*(chain[:, 1] - np.roll(chain[:, 0], -1, axis=0)).T) > reach).any():
                    continue
                v = chain[:, 0]
                sides = np.hypot(*(np.roll(v, -1, axis=0) - v).T)
                turn = np.array([(q - o)[0] * (centre - o)[1] - (q - o)[1] * (centre - o)[0] for o, q in zip(v, np.roll(v, -1, axis=0))])
                area = abs((v[1] - v[0])[0] * (v[2] - v[0])[1] - (v[2] - v[0])[0] * (v[1] - v[0])[1]) / 2
                if sides.min() >= 1.2 * h and sides.max() <= 8 * h and sides.max() <= 2.5 * sides.min() and ((turn > 0).all() or (turn < 0).all()) and (best is None or area < best[0]):
                    best = (area, (*v.min(0), *v.max(0)))
    return best[1] if best else None


def revision_markers(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """(sheet_id, ord, rev, drawn): text that marks a revision, and bare digits within a triangle drawn at their size. segments: (sheet_id,
    x1, y1, x2, y2); a digit meets only the segments near it."""
    from plumbline.operators.grid import meeting

    written = spans.withColumn("rev", revision_mark(F.col("str"))).where("rev IS NOT NULL").select("sheet_id", "ord", "rev", F.lit(False).alias("drawn"))
    h = F.greatest(F.coalesce("h", F.lit(8.0)), F.lit(6.0))
    digits = spans.where(F.trim("str").rlike("^[0-9]{1,2}$")).select("sheet_id", "ord", "str", "x", "y", "w", "h", (F.col("x") + F.col("w") / 2 - 9 * h).alias("x0"), (F.col("y") - 9 * h).alias("y0"), (F.col("x") + F.col("w") / 2 + 9 * h).alias("x1"), (F.col("y") + 10 * h).alias("y1"))
    long = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    lines = segments.where((long >= 4) & (long <= 400)).select("sheet_id", F.array("x1", "y1", "x2", "y2").alias("line"), F.least("x1", "x2").alias("x0"), F.least("y1", "y2").alias("y0"), F.greatest("x1", "x2").alias("x1"), F.greatest("y1", "y2").alias("y1"))
    near = meeting(digits, lines).groupBy(F.col("a.sheet_id").alias("sheet_id"), F.struct(*[F.col(f"a.{c}") for c in ("ord", "str", "x", "y", "w", "h")]).alias("d")).agg(F.collect_list("b.line").alias("lines")).where(F.size("lines") >= 3)

    def run(frames):
        for frame in frames:
            out = []
            for sheet, d, lines_ in zip(frame["sheet_id"], frame["d"], frame["lines"]):
                s = Span(int(d["ord"]), d["str"], float(d["x"]), float(d["y"]), float(d["w"] or 0), float(d["h"] or 0))
                if drawn_delta(s, np.array([list(x) for x in lines_], float)) is not None:
                    out.append((sheet, s.ord, s.text.strip(), True))
            yield pd.DataFrame(out, columns=["sheet_id", "ord", "rev", "drawn"])

    return written.unionByName(near.mapInPandas(run, "sheet_id long, ord long, rev string, drawn boolean"))


__all__ = ["callouts", "discipline", "drawn_delta", "mixed_scales", "revision_mark", "revision_markers", "revision_of", "scales_in", "sheet_info", "sheet_number", "title_block", "title_blocks", "view_scale_labels", "view_scales"]
