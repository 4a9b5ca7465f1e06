"""JSON objects as maps: deep merges, keys, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP, LIST = "map<string,string>", "array<string>"


def _object(text: Column) -> Column:
    """The members of a JSON object with their values as JSON or bare text; null if it isn't one."""
    return F.when(F.trim(text).startswith("{"), F.from_json(text, MAP))


def deep_merge(old: Column, new: Column, depth: int = 2) -> Column:
    """Members of both objects as map<string,string>: the old one wins, objects merge, lists are united.

    Objects are merged down to `depth` levels; a list keeps its own order, then the
    other's new items. Values that are objects or lists stand as JSON.
    """
    empty = F.create_map().cast(MAP)
    a, b = F.coalesce(_object(old), empty), F.coalesce(_object(new), empty)
    return F.map_zip_with(a, b, lambda k, x, y: _value(x, y, depth))


def _value(x: Column, y: Column, depth: int) -> Column:
    lists = F.to_json(F.array_distinct(F.concat(F.from_json(x, LIST), F.from_json(y, LIST))))
    both = lambda mark: F.startswith(F.trim(x), F.lit(mark)) & F.startswith(F.trim(y), F.lit(mark))
    merged = F.when(x.isNull(), y).when(y.isNull(), x).when(both("["), lists)
    if depth > 1:
        merged = merged.when(both("{"), F.to_json(deep_merge(x, y, depth - 1)))
    return merged.otherwise(x)


def member_count(text: Column) -> Column:
    """Members of a JSON object, 0 for anything else."""
    return F.coalesce(F.size(F.json_object_keys(text)), F.lit(0))


def moved_to_end(items: Column, item: Column) -> Column:
    return F.array_append(F.array_remove(items, item), item)
