"""Typed values: columns that hold text, numbers, booleans, lists and maps side by side, as VARIANT.

The kinds stand in a fixed order, which sorting uses: numbers, text, booleans, structured values, missing ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of a map that its shape names.
SHAPE_KEYS = 32


def let(value: Column, use) -> Column:
    """use(value) with value worked out once: the expression stands once in the plan, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kind(value: Column) -> Column:
    """number, text, boolean, array, map, or missing (null and JSON null)."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (name == "VOID"), "missing").when(name == "STRING", "text").when(name == "BOOLEAN", "boolean")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "map").otherwise("number")
    )


def plain_text(value: Column) -> Column:
    """A value's text: strings as they are, numbers and booleans in plain form, structured ones as JSON; null if missing."""
    return F.when(kind(value) == "text", F.try_variant_get(value, "$", "string")).when(kind(value) != "missing", F.to_json(value))


def number(value: Column) -> Column:
    """The number that a value is, or that its text is; null otherwise."""
    text = F.trim(F.try_variant_get(value, "$", "string"))
    return F.when(kind(value) == "number", F.try_variant_get(value, "$", "double")).when((kind(value) == "text") & (text != ""), text.try_cast("double"))


def shape(value: Column) -> Column:
    """What a body without text is called: {its keys in order}, [array], <NUM>, <BOOL>, or <empty>."""
    keys = F.array_sort(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))
    more = F.when(F.size(keys) > SHAPE_KEYS, ",…").otherwise("")
    named = F.concat(F.lit("{"), F.array_join(F.slice(keys, 1, SHAPE_KEYS), ","), more, F.lit("}"))
    of = kind(value)
    return F.when(of == "map", named).when(of == "array", "[array]").when(of == "number", "<NUM>").when(of == "boolean", "<BOOL>").otherwise("<empty>")


def sort_key(value: Column) -> Column:
    """A struct that sorts as the kinds do: numbers (also as text) by size, text by its signs, booleans, structured values as equals."""
    n, of = number(value), kind(value)
    rank = F.when(n.isNotNull(), 0).when(of == "text", 1).when(of == "boolean", 2).when(of == "missing", 4).otherwise(3)
    text = F.when(rank == 1, F.try_variant_get(value, "$", "string"))
    return F.struct(rank.alias("rank"), F.when(rank == 0, n).alias("number"), text.alias("text"), F.when(rank == 2, F.try_variant_get(value, "$", "boolean")).alias("boolean"))


def typed(value: Column, data_type: str) -> Column:
    """A column of any type as a typed value; texts are not parsed."""
    return value if data_type == "variant" else value.cast("variant")


def attr_text(attrs: Column, key: str) -> Column:
    """The text of a typed attribute; null if it is missing."""
    return plain_text(F.try_element_at(attrs, F.lit(key)))


def attr_number(attrs: Column, key: str) -> Column:
    """The number that a typed attribute is, or that its text is."""
    return number(F.try_element_at(attrs, F.lit(key)))


def body_text(body: Column) -> Column:
    """What a body shows: its text, or its JSON; empty if missing."""
    return F.coalesce(plain_text(body), F.lit(""))
