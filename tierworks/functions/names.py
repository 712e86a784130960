"""Qualified names: ``layer.table@store``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layers in their display order.
LAYERS = ("staging", "bronze", "silver", "gold")
UNKNOWN_LAYER = "unknown"


def qualified_name(layer: Column, table: Column, store: str) -> Column:
    return F.concat(layer, F.lit("."), table, F.lit("@" + store))


def table_part(qualified: Column) -> Column:
    """Text after the first dot of the part before ``@``; the whole part without a dot."""
    head = F.substring_index(qualified, "@", 1)
    dot = F.locate(".", head)
    return F.when(dot > 0, F.substr(head, dot + 1)).otherwise(head)


def layer_from_name(qualified: Column) -> Column:
    head = F.substring_index(qualified, ".", 1)
    has_dot = F.contains(qualified, F.lit("."))
    return F.when(has_dot & head.isin(*LAYERS), head).otherwise(UNKNOWN_LAYER)


def layer_of(qualified: Column, declared: Column) -> Column:
    """The declared layer, else the one the name starts with."""
    return F.when(F.length(declared) > 0, declared).otherwise(layer_from_name(qualified))


def layer_position(layer: Column) -> Column:
    """1 for the first layer; names that are no layer sort last."""
    order = F.array(*[F.lit(x) for x in (*LAYERS, UNKNOWN_LAYER)])
    at = F.array_position(order, layer)
    return F.when(at > 0, at).otherwise(99)
