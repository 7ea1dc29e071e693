"""Sheet keys, orders and tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHEET = r"^(?s)(.+)#([0-9]+)$"


def sheet_file(sheet: Column) -> Column:
    """The file of a sheet key: what stands before the last # that a number follows, else the key."""
    return F.when(sheet.rlike(_SHEET), F.regexp_extract(sheet, _SHEET, 1)).otherwise(sheet)


def sheet_page(sheet: Column) -> Column:
    """The page of a sheet key; 1 without one."""
    return F.when(sheet.rlike(_SHEET), F.regexp_extract(sheet, _SHEET, 2).try_cast("int")).otherwise(F.lit(1))


def sheet_order(sheet: Column) -> list[Column]:
    """Canonical order: file by locale, then page by number."""
    return [F.collate(sheet_file(sheet), "UNICODE"), sheet_page(sheet), sheet]


def sheet_label(sheet: Column) -> Column:
    """plan.pdf#3 as 'plan — p.3'; first pages are the plan's name alone."""
    stem = F.regexp_replace(sheet_file(sheet), r"(?i)\.pdf$", "")
    return F.when(sheet_page(sheet) > 1, F.concat(stem, F.lit(" — p."), sheet_page(sheet).cast("string"))).otherwise(stem)


def tag_key(tag: Column) -> Column:
    """The form in which human tags are matched."""
    return F.upper(F.trim(tag))


def mark_key(mark: Column) -> Column:
    """The form in which drawing marks are matched: no white space at all."""
    return F.upper(F.regexp_replace(mark, r"\s+", ""))


def natural_key(text: Column, width: int = 12) -> Column:
    """A key whose binary order reads numbers by value: each run of digits is padded, letters are folded."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, width, "0")).otherwise(p)), "")


def csv_cell(value: Column, is_text: bool = True) -> Column:
    """A CSV cell: text that a spreadsheet would run as a formula gets a leading quote mark; numbers never do."""
    text = value.cast("string")
    if is_text:
        text = F.when(text.rlike(r"^[=+\-@\t]"), F.concat(F.lit("'"), text)).otherwise(text)
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike(r'[",\n\r]'), quoted).otherwise(text), F.lit(""))
