"""Write semantics as ``(target, source) -> new target`` transformations.

Plain parquet tables have no MERGE, so each operator returns the next version of
the table. Target rows are never shuffled for a small batch: matching goes through
``target semi batch`` first, which Spark can broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.joins import drop_matching
from recordloom.schemas import ForeignKey

Key = str | Column


def _with_keys(df: DataFrame, keys: list[Key]) -> tuple[DataFrame, list[str]]:
    """``df`` with a column for every key that is an expression, and the names of all key columns."""
    names = [k if isinstance(k, str) else f"_k{i}" for i, k in enumerate(keys)]
    return df.withColumns({n: k for n, k in zip(names, keys) if not isinstance(k, str)}), names


def _no_null(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


def pick_first(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """One row per key: the smallest by ``order_by``, remaining columns breaking ties.

    A minimum over structs merges on the map side, so a hot key leaves each task as
    one row; a ranking window would sort the whole group in one task.
    """
    ordered = [c for c in dict.fromkeys([*order_by, *df.columns]) if c not in keys]
    if not ordered:
        return df.select(*df.columns).distinct()
    first = F.min(F.struct(*ordered)).alias("_first")
    return df.groupBy(*keys).agg(first).select(
        *[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns]
    )


def _unique_or_fail(df: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("_row"), F.count("*").alias("_n"))
    row = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(F.concat(F.lit("several rows to upsert for key "), F.to_json(F.struct(*keys))))
    )
    return grouped.withColumn("_row", row).select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def _unmatched(source: DataFrame, target: DataFrame, names: list[str]) -> DataFrame:
    hits = target.select(*names).join(source.select(*names), names, "left_semi")
    return drop_matching(source, hits, names)


def _conform(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, absent ones as NULL."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in like.schema.fields
    ])


def first_wins(target: DataFrame, source: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """Insert the first source row of each key that the target does not hold yet."""
    batch = pick_first(source, [key], order_by)
    return target.unionByName(_conform(_unmatched(batch, target, [key]), target))


def insert_ignore(
    target: DataFrame, source: DataFrame, keys: list[Key], order_by: list[str] | None = None
) -> DataFrame:
    """Insert source rows whose key is new; a key with a NULL part never conflicts.

    Keys may be expressions such as ``F.lower('name')``. Among equal keys in the
    source the smallest row by ``order_by`` (then by all columns) is inserted.
    """
    keyed, names = _with_keys(source, keys)
    existing, _ = _with_keys(target, keys)
    complete = keyed.where(_no_null(names))
    first = pick_first(complete, names, order_by or source.columns)
    fresh = _unmatched(first, existing.where(_no_null(names)), names)
    loose = keyed.where(~_no_null(names))
    return target.unionByName(_conform(fresh, target)).unionByName(_conform(loose, target))


def insert_where_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Insert all source rows for which the target holds no row with equal keys (no dedup in the source)."""
    return target.unionByName(_conform(_unmatched(source, target, keys), target))


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: list[Key],
    update_cols: list[str],
    set_cols: dict[str, Column] | None = None,
    insert_cols: dict[str, Column] | None = None,
) -> DataFrame:
    """Update ``update_cols`` of matching rows and insert the others.

    Columns that are not named keep their old value. ``set_cols`` gives values that an
    update stamps (such as a modification time), ``insert_cols`` defaults of new rows.
    Two source rows with one key fail the job, as the outcome would be a matter of
    chance; the target may hold a key several times (update-else-insert), all are updated.
    """
    keyed, names = _with_keys(source, keys)
    current, _ = _with_keys(target, keys)
    batch, loose = _unique_or_fail(keyed.where(_no_null(names)), names), keyed.where(~_no_null(names))
    new_values = {c: F.col(c) for c in update_cols} | (set_cols or {})
    changes = batch.select(
        *names, F.struct(*[v.alias(c) for c, v in new_values.items()]).alias("_new")
    )
    updated = current.join(changes, names, "left").select(*[
        (
            F.when(F.col("_new").isNotNull(), F.col("_new")[f.name].cast(f.dataType)).otherwise(F.col(f.name))
            if f.name in new_values else F.col(f.name)
        ).alias(f.name)
        for f in target.schema.fields
    ])
    inserted = _unmatched(batch, current, names).unionByName(loose).withColumns(insert_cols or {})
    return updated.unionByName(_conform(inserted, target))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns where the condition is true; elsewhere, also for NULL, rows stay as they are."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_propagate(
    tables: dict[str, DataFrame], fks: list[ForeignKey], table: str, keys: DataFrame
) -> dict[str, DataFrame]:
    """Delete the rows of ``table`` whose key is in ``keys`` and follow the foreign keys.

    Cascading references delete their rows in turn, "set null" references are emptied.
    ``keys`` has one column, named like the key of ``table``. Returns the new tables.
    The reference graph may hold a cycle only through "set null" edges.
    """
    result = dict(tables)
    doomed: dict[str, list[tuple[str, DataFrame]]] = {}

    def condemn(name: str, column: str, values: DataFrame) -> None:
        doomed.setdefault(name, []).append((column, values))
        for fk in fks:
            if fk.parent != name or fk.child not in tables or fk.on_delete != "cascade":
                continue
            parents = values.select(F.col(column).alias(fk.parent_key)) if column == fk.parent_key else (
                tables[name].join(values, column, "left_semi").select(fk.parent_key)
            )
            condemn(fk.child, fk.column, parents.select(F.col(fk.parent_key).alias(fk.column)))

    (key_column,) = keys.columns
    condemn(table, key_column, keys.distinct())

    for name, conditions in doomed.items():
        for column, values in conditions:
            result[name] = drop_matching(result[name], values, column).select(*tables[name].columns)
    for fk in fks:
        if fk.on_delete != "set null" or fk.child not in tables or fk.parent not in doomed:
            continue
        for column, values in doomed[fk.parent]:
            gone = tables[fk.parent].join(values, column, "left_semi").select(
                F.col(fk.parent_key).alias(fk.column)
            ).distinct().withColumn("_gone", F.lit(True))
            result[fk.child] = (
                result[fk.child].join(gone, fk.column, "left")
                .withColumn(fk.column, F.when(F.col("_gone").isNull(), F.col(fk.column)))
                .select(*tables[fk.child].columns)
            )
    return result
