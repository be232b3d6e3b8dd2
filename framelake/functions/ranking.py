"""Column expressions that score a frame for a parsed query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attribute_types(query: Column) -> Column:
    """How many of labels, colours and sizes the query names."""
    return sum(((F.size(query[k]) > 0).cast("int") for k in ("labels", "colors", "sizes")), F.lit(0))


def _covered(o: Column, query: Column) -> Column:
    pairs = (("labels", "label"), ("colors", "color_name"), ("sizes", "size"))
    return sum((F.coalesce(F.array_contains(query[k], o[f]), F.lit(False)).cast("int") for k, f in pairs), F.lit(0))


def best_object(objects: Column, query: Column) -> Column:
    """Struct(covered, label_hit, neg, o) of the object that covers most types; a label hit, then the earliest, breaks ties."""
    scored = F.transform(objects, lambda o, i: F.struct(_covered(o, query).alias("covered"), F.coalesce(F.array_contains(query["labels"], o["label"]), F.lit(False)).cast("int").alias("label_hit"), (-i).alias("neg")))
    top = F.array_max(scored)
    return F.when(top["covered"] > 0, top)


def structure(best: Column, query: Column) -> Column:
    """Share of the query's attribute types that the best object has."""
    return F.when(best.isNotNull(), best["covered"] / attribute_types(query)).otherwise(F.lit(0.0))


def dominance(objects: Column, query: Column) -> Column:
    """log(1 + objects that cover every type) / log(2 + objects); 0 without one."""
    full = F.size(F.filter(objects, lambda o: _covered(o, query) >= attribute_types(query)))
    return F.when((attribute_types(query) > 0) & (full > 0), F.log1p(full.cast("double")) / F.log1p(F.size(objects) + F.lit(1.0))).otherwise(F.lit(0.0))


def matches(best: Column, objects: Column, labels: Column, query: Column) -> dict[str, Column]:
    """label_match, color_match, size_match: shares of the query's values on the best object, or on the whole frame."""
    chosen = F.get(objects, -best["neg"])
    out = {}
    for name, key, own, whole in (
        ("label_match", "labels", chosen["label"], labels),
        ("color_match", "colors", chosen["color_name"], F.transform(objects, lambda o: o["color_name"])),
        ("size_match", "sizes", chosen["size"], F.transform(objects, lambda o: o["size"])),
    ):
        n = F.size(query[key])
        share = F.when(best.isNotNull(), F.coalesce(F.array_contains(query[key], own), F.lit(False)).cast("int")).otherwise(F.size(F.array_intersect(query[key], whole)))
        value = F.when(attribute_types(query) == 0, F.lit(0.0)).when(n == 0, F.lit(1.0)).otherwise(share / n)
        out[name] = F.round(value, 4)
    return out
