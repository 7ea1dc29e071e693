"""All queries of the library's own operators."""

from plumbline.driver import (  # noqa: F401
    drawing_queries,
    geometry_queries,
    ink_queries,
    mask_queries,
    merge_queries,
    net_queries,
    more_queries,
    other_queries,
    overlay_queries,
    plan_queries,
    records_queries,
    session_queries,
    set_queries,
    shape_queries,
    text_queries,
    totals_queries,
)
from plumbline.driver.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
