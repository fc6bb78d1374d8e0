"""Predicates: the serving gate, resolved concepts, and path matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_blank

#: The least confidence at which a proposed edge of a type is served.
BARS = {"describes": 0.9, "relates": 0.7, "implements": 0.0, "constrains": 0.0}


def served(least: Column | float, status="status", confidence="confidence") -> Column:
    """Confirmed, or proposed with at least this confidence."""
    return (F.col(status) == "confirmed") | ((F.col(status) == "proposed") & (F.col(confidence) >= (least if isinstance(least, Column) else F.lit(float(least)))))


def bar_of_type(edge_type="type") -> Column:
    """The bar of each edge's type; types without one are never served by it."""
    bars = F.create_map(*[x for k, v in BARS.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(bars, F.col(edge_type))


def resolved(definition="definition") -> Column:
    return ~is_blank(definition)


def not_rejected(status="status") -> Column:
    return F.col(status) != "rejected"


def on_path(ref, path, strict: bool = True) -> Column:
    """Whether a reference is at or under a path prefix (no boundary at /).

    Not strict: letters of either case match, and _ and % in the path are wildcards.
    """
    ref, path = (F.col(x) if isinstance(x, str) else x for x in (ref, path))
    if strict:
        return ref.startswith(path)
    pattern = F.concat(F.replace(F.lower(path), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return F.like(F.lower(ref), pattern)


def in_file(ref, path) -> Column:
    """The file itself or a symbol of it."""
    ref, path = (F.col(x) if isinstance(x, str) else x for x in (ref, path))
    return (ref == path) | ref.startswith(F.concat(path, F.lit("#")))
