"""Counters and other keyed reductions, thresholds, arg-max with ties, and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def _reduce(rows: DataFrame, keys: Keys, agg: Column, into: str, existing: DataFrame | None) -> DataFrame:
    """existing: a table of the keys that count; rows of other keys are left out before anything is shuffled for the sum."""
    if existing is not None:
        rows = rows.join(existing.select(*keys).distinct(), list(keys), "left_semi")
    return rows.groupBy(*keys).agg(agg.alias(into))


def increment(rows: DataFrame, keys: Keys, by: Column | int = 1, into: str = "total", existing: DataFrame | None = None) -> DataFrame:
    """A running total per key."""
    return _reduce(rows, keys, F.sum(by if isinstance(by, Column) else F.lit(by)), into, existing)


def multiply(rows: DataFrame, keys: Keys, by: Column, into: str = "product", existing: DataFrame | None = None) -> DataFrame:
    return _reduce(rows, keys, F.product(by), into, existing)


def maximize(rows: DataFrame, keys: Keys, value: Column, into: str = "greatest", existing: DataFrame | None = None) -> DataFrame:
    return _reduce(rows, keys, F.max(value), into, existing)


def minimize(rows: DataFrame, keys: Keys, value: Column, into: str = "least", existing: DataFrame | None = None) -> DataFrame:
    return _reduce(rows, keys, F.min(value), into, existing)


def merge_tables(a: DataFrame, b: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Two counters as one: the totals of each key are added."""
    return a.unionByName(b).groupBy(*keys).agg(F.sum(value).alias(value))


def merge_sets(a: DataFrame, b: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Two tables of sets as one: the sets of each key are united."""
    both = a.unionByName(b).select(*keys, F.explode(value).alias(value))
    return both.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(value))


def table_max(table: DataFrame, value: str, scope: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    """The rows of the greatest value, all that tie, of the keys in scope. The maximum is an aggregate of its own, so that no task
    has to rank all rows."""
    if scope is not None:
        table = table.join(scope.select(*keys).distinct(), list(keys), "left_semi")
    top = table.agg(F.max(value).alias("__top"))
    return table.join(F.broadcast(top), F.col(value) == F.col("__top")).drop("__top")


def table_min(table: DataFrame, value: str) -> DataFrame:
    low = table.agg(F.min(value).alias("__low"))
    return table.join(F.broadcast(low), F.col(value) == F.col("__low")).drop("__low")


def skim(table: DataFrame, value: str, least: float) -> DataFrame:
    """The rows whose value is at least `least`."""
    return table.where(F.col(value) >= least)


def largest_of(rows: DataFrame, group: Keys, key: Column) -> DataFrame:
    """The rows of the greatest key in each group, all that tie; rows without a key are skipped. The greatest key is found by a
    partial aggregate, so that a large group isn't sorted."""
    return _extreme(rows, group, key, F.max)


def smallest_of(rows: DataFrame, group: Keys, key: Column) -> DataFrame:
    return _extreme(rows, group, key, F.min)


def _extreme(rows: DataFrame, group: Keys, key: Column, fn) -> DataFrame:
    keyed = rows.withColumn("__key", key)
    if not group:
        best = keyed.agg(fn("__key").alias("__best"))
        return keyed.join(F.broadcast(best), F.col("__key") == F.col("__best")).drop("__key", "__best")
    best = keyed.groupBy(*(F.col(g).alias(f"__g_{g}") for g in group)).agg(fn("__key").alias("__best"))
    on = F.col("__key") == F.col("__best")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return keyed.join(best, on).drop("__key", "__best", *(f"__g_{g}" for g in group))


def pick_max(rows: DataFrame, k: int, key: Column, ties: Sequence[str], numbers_only: bool = False) -> DataFrame:
    """The k rows of the greatest keys (sorted so), with `ties` to settle equal ones; each task keeps k rows."""
    if numbers_only:
        rows = rows.where(key.cast("double").isNotNull())
    return rows.orderBy(key.desc_nulls_last(), *ties).limit(k)


def pick_min(rows: DataFrame, k: int, key: Column, ties: Sequence[str], numbers_only: bool = False) -> DataFrame:
    if numbers_only:
        rows = rows.where(key.cast("double").isNotNull())
    return rows.orderBy(key.asc_nulls_last(), *ties).limit(k)


def top_per_group(rows: DataFrame, group: Keys, k: int, order: Sequence[Column], into: str = "place") -> DataFrame:
    """The first k rows of each group in an order. Each task first keeps k rows of each group it sees (Spark pushes the rank limit
    below the shuffle)."""
    ranked = rows.withColumn(into, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(into) <= k)


def sort_key(column: Column, kind: str = "normal") -> Column:
    """The key of a kind of sorting: normal, lexical (by code point), lexci (ignoring case), collate (by the rules of Unicode)."""
    if kind == "lexci":
        return F.lower(column.cast("string"))
    if kind == "collate":
        return F.collate(column.cast("string"), "UNICODE")
    return column.cast("string") if kind == "lexical" else column


def sorted_rows(rows: DataFrame, key: Column, ties: Sequence[str], kind: str = "normal", reverse: bool = False) -> DataFrame:
    k = sort_key(key, kind)
    return rows.orderBy(k.desc_nulls_last() if reverse else k.asc_nulls_first(), *ties)


def reduce_choice(rows: DataFrame, group: Keys, value: Column, fn: str, into: str, select: Column | None = None) -> DataFrame:
    """A set folded by a named function that may be applied in any order: sum, product, min, max, count, any, every, union."""
    fns = {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max, "count": F.countDistinct, "any": F.bool_or, "every": F.bool_and, "union": lambda c: F.array_sort(F.collect_set(c))}
    agg = fns[fn](value if select is None else F.when(select, value))
    return rows.groupBy(*group).agg(agg.alias(into)) if group else rows.agg(agg.alias(into))


def count_references(facts: DataFrame) -> DataFrame:
    """How often each frame is a value of a slot."""
    return facts.where("vtype = 'oid'").groupBy(F.col("vo").alias("oid")).agg(F.count("*").alias("refs"))
