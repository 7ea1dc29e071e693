"""What kind of drawing a sheet is, by its title evidence; and where room labels are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.scratch import shuffled

# Title patterns with their role and confidence, in order; words that no room tag holds; shares of the sheet and of
# text sizes that tell a title from a view's name.
ROLE_PATTERNS = [
    (r"DEMOLITION\s+PLAN|DEMO\s+PLAN", "demolition", 0.9),
    (r"(?:FINISH|FLOOR|FURNITURE|CEILING|DUCTWORK|PIPING|MECHANICAL|ELECTRICAL|LIGHTING|POWER|PLUMBING|SPRINKLER|HVAC|FRAMING|FOUNDATION|ROOF|SITE|EQUIPMENT)\s+PLANS?\b", "plan", 0.85),
    (r"^[A-Z][A-Z ()/&.'’-]* SCHEDULE", "schedule", 0.85),
    (r"SCHEDULE", "schedule", 0.5),
    (r"LEGEND", "legend", 0.5),
    (r"ELEVATIONS?\b", "elevation", 0.7),
    (r"DETAILS?\b|SECTIONS?\b", "detail", 0.6),
    (r"(?<![A-ZÆØÅÄÖÜ])(?<!DEMOLITION\s)(?<!DEMO\s)PLANS?(?:\s*$|\s*(?:AND|&)\s)", "plan", 0.85),
]
# The same in Norwegian, Danish, Swedish and German: words (as heads of compounds where nothing stands before them), their endings, role and confidence; patterns that count on sheets with
# Nordic text alone; words that look like a role and are none; what Nordic text is.
_LETTER = "A-ZÆØÅÄÖÜ"
EUROPEAN_WORDS = [
    (["TEGNFORKLARING", "SYMBOLFORKLARING", "SIGNATURFORKLARING", "SYMBOLLISTE", "TECKENFÖRKLARING", "LEGENDE"], ["ER", "EN", "R", "N"], "legend", 0.5),
    (["SKJEMA", "FORTEGNELSE", "FÖRTECKNING"], ["ER", "ET", "NE", "N"], "schedule", 0.85),
    (["RIVEPLAN", "RIVETEGNING", "RIVING", "NEDRIVNING", "RIVNING", "ABBRUCH"], ["ER", "EN", "SPLAN"], "demolition", 0.9),
    (["FASADE", "FASAD", "FACADE", "OPPRISS", "ANSICHT", "ELEVASJON"], ["R", "N", "NE", "ER", "EN"], "elevation", 0.7),
    (["SNITT", "SNIT", "SEKTION", "SCHNITT", "DETALJ", "DETALJE"], ["ER", "ET", "TEGNING", "TEGNINGER", "S", "E", "EN"], "detail", 0.6),
]
EUROPEAN_PATTERNS = [(rf"(?:{'|'.join(words)})(?:{'|'.join(ends)})?(?![{_LETTER}])", role, conf) for words, ends, role, conf in EUROPEAN_WORDS] + [
    (rf"(?<![{_LETTER}])(?!SYMBOL)[{_LETTER}]{{3,}}LISTE(?:R|N|NE)?(?![{_LETTER}])", "schedule", 0.85),
    (rf"(?<![{_LETTER}])(?!RIV|NEDRIV|ABBRUCH)[{_LETTER}]+PLAN(?:ER|EN|ET)?(?![{_LETTER}])|(?<![{_LETTER}])PLAN(?:TEGNING(?:ER)?|LØSNING|RITNING)(?![{_LETTER}])|(?<![{_LETTER}])GRUNDRISS(?:E)?(?![{_LETTER}])", "plan", 0.85),
]
NORDIC_PATTERNS = [
    (rf"(?<![{_LETTER}])PLAN\s*[-–:]?\s*(?:\d|[UHK]\s?\d|U(?![{_LETTER}])|LOFT|TAK|KJELLER|SOKKEL|UNDER|HOVED|ETASJE|ETG)", "plan", 0.85),
    (rf"(?:\d+\s*\.?|(?<![{_LETTER}])U\.?|UNDER|SOKKEL|HOVED|LOFT)\s*(?:ETASJE|ETG)(?![{_LETTER}])|(?<![{_LETTER}])(?:KJELLER|LOFT)(?:ETASJE)?(?![{_LETTER}])", "plan", 0.7),
]
NOT_A_ROLE = r"(?:INNHOLDS|TEGNINGS|DOKUMENT|SJEKK|KONTROLL|TILBUDS|SAMORDNINGS|SØKNADS|REVISJONS|MENGDE|PRIS|ENDRINGS)(?:SKJEMA|LISTE)|(?:PRINSIPP|SYSTEM|KOBLINGS|FLYT|STRØM|STIGE|ENLINJE)SKJEMA|KEY\s*PLAN|NØKKELPLAN|PLAN\s*NORTH|PLAN-\s*OG\s*BYGNINGS"
REFERENCE = r"^(?:SEE|REFER|REF|PER|NOTED|AS SHOWN|JF|JFR|IHT|REV|REVISION|REVISJON)\b|\b(?:SE|IHT\.?|JF\.?) [A-ZÆØÅ]*(?:TEGNING|PLAN|DETALJ|SNITT|FASADE|OPPRISS|SKJEMA)"
NORDIC_TEXT = rf"(?i)[{_LETTER}]*[ÆØÅ][{_LETTER}]+|[{_LETTER}]+[ÆØÅ]|(?<![{_LETTER}])(?:ETASJE|ETG|TEGNING|TEGNINGSNR|SNITT|FASADE|SKJEMA|TILTAKSHAVER|PLANTEGNING|OPPRISS)(?![{_LETTER}])"
NON_ROOM_WORDS = ["BUILDING", "BLDG", "SHEET", "DRAWING", "DWG", "PROJECT", "NO", "NUMBER", "SCALE", "DATE", "REV", "REVISION", "PHASE", "CONTRACT", "OF", "DETAIL", "SECTION", "PLAN", "NORTH", "KEY", "NOTE", "NOTES", "TOTAL", "AREA"]
TITLE_X, TITLE_Y, VIEW_SIZE, TALL, BODY_FACTOR, LEGEND_CAP = 0.6, 0.55, 1.4, 0.85, 0.8, 0.4
MOST_WORDS = 7


def role_term(text: Column, nordic: Column | None = None) -> Column:
    """(role, confidence) that a short line names, the pattern that matches first in it leading; null for notes and references. English, Norwegian, Danish, Swedish and German names;
    nordic: whether the sheet's text is Nordic, for names that would be running text elsewhere."""
    u = F.trim(F.regexp_replace(F.upper(F.trim(text)), NOT_A_ROLE, " "))
    short = (F.length(u) >= 4) & (F.length(u) <= 80) & (F.size(F.split(u, r"\s+")) <= MOST_WORDS) & ~u.rlike(REFERENCE)
    known = [(p, role, conf, None) for p, role, conf in ROLE_PATTERNS + EUROPEAN_PATTERNS] + [(p, role, conf, nordic) for p, role, conf in NORDIC_PATTERNS if nordic is not None]
    hits = F.array_compact(F.array(*[
        F.when(u.rlike(p) & (F.lit(True) if gate is None else gate), F.struct(F.regexp_instr(u, F.lit(f"({p})")).alias("at"), F.lit(i).alias("place"), F.lit(role).alias("role"), F.lit(conf).alias("confidence"))) for i, (p, role, conf, gate) in enumerate(known)
    ]))
    first = F.array_min(hits)
    others = F.exists(hits, lambda h: h["role"] != first["role"])
    return F.when(short & (F.size(hits) > 0), F.struct(first["role"].alias("role"), F.when(others, first["confidence"] / 2).otherwise(first["confidence"]).alias("confidence")))


def sheet_roles(spans: DataFrame, sheets: DataFrame) -> DataFrame:
    """(sheet_id, role, confidence, evidence) of each sheet: spans (sheet_id, ord, str, x, y, h), sheets (sheet_id, width, height).

    A name in the title block's corner decides; of several about as tall, the one nearest the corner. Else the tallest name of a view,
    trusted less; else what the body's names agree on. Rivals of another role as tall halve the confidence. Sheets without
    a name are unknown; they stay.
    """
    nordic = spans.groupBy(F.col("sheet_id").alias("n_id")).agg(F.max(F.coalesce(F.col("str").rlike(NORDIC_TEXT), F.lit(False))).alias("nordic"))
    read = spans.join(shuffled(nordic), F.col("sheet_id") == F.col("n_id")).drop("n_id")
    named = read.withColumn("term", role_term(F.col("str"), F.col("nordic"))).drop("nordic").where("term IS NOT NULL").join(shuffled(sheets.select(F.col("sheet_id").alias("s_id"), "width", "height")), F.col("sheet_id") == F.col("s_id"))
    median = spans.groupBy(F.col("sheet_id").alias("m_id")).agg(F.percentile("h", 0.5).alias("median_h"))
    sized = named.join(shuffled(median), F.col("sheet_id") == F.col("m_id"))
    corner = (F.col("x") >= TITLE_X * F.col("width")) & (F.col("y") >= TITLE_Y * F.col("height")) & (F.col("h") >= F.col("median_h"))
    pool = F.when(corner & (F.col("term.role") != "legend"), 0).when(~corner & (F.col("h") >= VIEW_SIZE * F.col("median_h")), 1).otherwise(2)
    pooled = sized.withColumn("pool", pool)
    best = pooled.groupBy(F.col("sheet_id").alias("b_id")).agg(F.min("pool").alias("best_pool"))
    held = pooled.join(shuffled(best), (F.col("sheet_id") == F.col("b_id")) & (F.col("pool") == F.col("best_pool")))
    tallest = F.max("h").over(Window.partitionBy("sheet_id"))
    away = F.hypot(F.col("width") - F.col("x"), F.col("height") - F.col("y"))
    tall = held.withColumns({"tall": F.col("h") >= TALL * tallest, "away": away})
    order = [F.desc("tall"), F.when(F.col("pool") == 0, F.col("away")).otherwise(-F.col("h")), F.desc("term.confidence"), "ord"]
    ranked = tall.withColumns({"k": F.row_number().over(Window.partitionBy("sheet_id").orderBy(*order)), "lead": F.first("term.role").over(Window.partitionBy("sheet_id").orderBy(*order))})
    rivals = F.max((F.col("tall") & (F.col("term.role") != F.col("lead"))).cast("int")).over(Window.partitionBy("sheet_id"))
    judged = ranked.withColumn("rivals", rivals).where("k = 1")
    trust = F.col("term.confidence") * F.when(F.col("pool") == 0, 1.0).otherwise(BODY_FACTOR) * F.when(F.col("rivals") == 1, 0.5).otherwise(1.0)
    split = (F.col("pool") == 2) & (F.col("rivals") == 1)
    answer = judged.select(F.col("sheet_id").alias("a_id"), F.when(split, "unknown").otherwise(F.col("term.role")).alias("role"), F.when(split, 0.0).when(F.col("term.role") == "legend", F.least(trust, F.lit(LEGEND_CAP))).otherwise(trust).alias("confidence"), F.col("str").alias("evidence"))
    joined = sheets.join(shuffled(answer), F.col("sheet_id") == F.col("a_id"), "left")
    return joined.select("sheet_id", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("evidence", F.lit("")).alias("evidence"))


def room_seed(text: Column) -> Column:
    """The room number of a label such as OFFICE 101; null for quantities, codes with other numbers, and the words of a title block."""
    tokens = F.split(F.trim(text), r"\s+")
    numbers = F.filter(tokens, lambda t: t.rlike(r"^[0-9]{2,3}[A-Z]?$"))
    number = F.try_element_at(numbers, F.lit(1))
    unit = text.rlike(r"""(?i)[0-9]\s*(?:SF|S\.F\.|SQ\.?\s*FT|GSF|NSF|["'′″]|-\s*[0-9]+["'])""")
    other = F.exists(tokens, lambda t: (t != number) & t.rlike(r"^[0-9]+(?:\.[0-9]+)?$"))
    word = F.exists(tokens, lambda t: F.upper(F.regexp_replace(t, "[^A-Za-z]", "")).isin(NON_ROOM_WORDS))
    return F.when(number.isNotNull() & ~unit & ~F.coalesce(other, F.lit(False)) & ~word, number)
