"""A view over a table, kept up to date by change sets: only the groups that changes touch are worked out again."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import checkpointed
from lodestar.sources.versioned import VersionedTables


def matched(rows: DataFrame, keys: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Rows with (left_semi) or without (left_anti) their like in `keys`; null equals null."""
    named = keys.select(*[F.col(c).alias(f"_k_{c}") for c in columns])
    return rows.join(named, reduce(lambda a, b: a & b, [rows[c].eqNullSafe(named[f"_k_{c}"]) for c in columns]), how)


def last_changes(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The change with the greatest `order` of each key; orders differ within a key."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def maintained(tables: VersionedTables, base: str, view: str, changes: DataFrame, keys: list[str], group: list[str], build: Callable[[DataFrame], DataFrame], version: int, order: str = "seq", deleted: str = "deleted") -> bool:
    """Apply changes to `base` and carry them on to `view`, both under one version; False if that version stands already.

    changes: the base's columns, `order`, and `deleted`; a row takes the place of its key's
    row, or is added, unless `deleted` is true. The base is kept by `keys`, the view by
    `group`, and `build` makes view rows of base rows, a group at a time. Touched groups
    are those of the changed rows as they were and as they are; a row that moves to
    another group touches both, and a group without rows leaves the view.

    Of the base only buckets of changed keys are written again, of the view only those of
    touched groups. Untouched buckets of the base are scanned for rows of touched groups,
    and just these rows are shuffled.
    """
    now = tables.snapshot()
    if version <= now.version:
        return False
    columns = tables.tables[base].schema.names
    last = checkpointed(last_changes(changes, keys, order))
    put = last.where(~F.coalesce(F.col(deleted), F.lit(False))).select(*columns)
    places = tables.touched(base, last)
    standing = now.read(base, places)
    groups = checkpointed(matched(standing, last, keys, "left_semi").select(*group).union(put.select(*group)).distinct())
    view_places = tables.touched(view, groups)

    after = matched(standing, last, keys, "left_anti").unionByName(put)
    elsewhere = now.read(base, set(range(tables.tables[base].buckets)) - set(places))
    fresh = build(matched(elsewhere.unionByName(after), groups, group, "left_semi"))
    kept = matched(now.read(view, view_places), groups, group, "left_anti")
    return tables.commit(version, {base: (after, places), view: (kept.unionByName(fresh.select(*kept.columns)), view_places)})
