"""Items, itemsets and their text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Item = tuple[int, int]
Itemset = tuple[Item, ...]
#: Fixed value: stands for all values of an attribute that no candidate asks for.
OTHER = -(1 << 63)
ITEM_TYPE = "struct<attr:int,value:bigint>"


def canonical(items: Iterable[Item]) -> Itemset:
    """Sorted items without repeats; two values of one attribute are an error."""
    found = tuple(sorted(set(items)))
    if len({a for a, _ in found}) < len(found):
        raise ValueError(f"two values of one attribute: {found}")
    return found


def canonical_column(items: Column) -> Column:
    """As canonical, for an array column: error where an attribute repeats."""
    found = F.array_sort(F.array_distinct(items))
    attributes = F.size(F.array_distinct(F.transform(found, lambda x: x["attr"])))
    return F.when(attributes == F.size(found), found).otherwise(F.raise_error(F.lit("two values of one attribute")))


def text(itemset: Iterable[Item]) -> str:
    return "{" + ", ".join(f"a{a}=OTHER" if v == OTHER else f"a{a}={v}" for a, v in itemset) + "}"


def text_column(items: Column) -> Column:
    def one(x: Column) -> Column:
        value = F.when(x["value"] == OTHER, F.lit("OTHER")).otherwise(x["value"].cast("string"))
        return F.concat(F.lit("a"), x["attr"].cast("string"), F.lit("="), value)

    return F.concat(F.lit("{"), F.array_join(F.transform(items, one), ", "), F.lit("}"))


def item_columns(pairs: list[tuple[Column, Column]]) -> Column:
    """An array of items from (attribute, value) columns."""
    return F.array(*(F.struct(a.cast("int").alias("attr"), v.cast("bigint").alias("value")) for a, v in pairs))


def local_part(items: Column, owner: dict[int, int], client: int) -> Column:
    """The items that a client owns."""
    mine = [a for a, c in owner.items() if c == client]
    return F.filter(items, lambda x: x["attr"].isin(mine))
