"""Set algebra, on array columns (a set inside a row) and on DataFrames (a set of rows).

A set column is a sorted array without duplicates or nulls; the empty set is an empty array, never null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# sets in a row


def as_set(values: Column) -> Column:
    """Any array as a set; null is the empty set."""
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(values, F.filter(values, lambda x: F.lit(False)), F.array().cast("array<void>")))))


def choice(*items: Column) -> Column:
    """The set of some values."""
    return as_set(F.array(*items))


def union(*sets: Column) -> Column:
    return as_set(reduce(F.array_union, sets))


def intersection(*sets: Column) -> Column:
    return as_set(reduce(F.array_intersect, sets))


def difference(first: Column, *others: Column) -> Column:
    return as_set(reduce(F.array_except, others, first))


def size(s: Column) -> Column:
    return F.size(s)


def is_empty(s: Column) -> Column:
    return F.size(s) == 0


def exists(s: Column) -> Column:
    return F.size(s) > 0


def is_unique(s: Column) -> Column:
    return F.size(s) == 1


def is_ambiguous(s: Column) -> Column:
    return F.size(s) > 1


def singleton(s: Column) -> Column:
    """The member if there is just one, else null (the empty value of a scalar)."""
    return F.when(F.size(s) == 1, F.element_at(s, 1))


def _none(s: Column) -> Column:
    return F.filter(s, lambda x: F.lit(False))


def choice_max(s: Column, limit: int) -> Column:
    """The set if it has at most `limit` members, else the empty set: all or nothing."""
    return F.when(F.size(s) <= limit, s).otherwise(_none(s))


def choice_min(s: Column, limit: int) -> Column:
    """The set if it has at least `limit` members, else the empty set; a lone value is never enough."""
    return F.when((F.size(s) > 1) & (F.size(s) >= limit), s).otherwise(_none(s))


def overlaps(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) > 0


def contains(a: Column, b: Column) -> Column:
    """Whether b's members are all in a; an empty b is."""
    return F.size(F.array_except(b, a)) == 0


def identical(a: Column, b: Column) -> Column:
    return as_set(a) == as_set(b)


def some(s: Column, test) -> Column:
    """False on the empty set."""
    return F.coalesce(F.exists(s, test), F.lit(False))


def every(s: Column, test) -> Column:
    """True on the empty set."""
    return F.coalesce(F.forall(s, test), F.lit(False))


def apply(fn, *sets: Column) -> Column:
    """A function on sets: its values on the product of their members, as a set; empty if any of them is."""

    def go(k: int, given: list) -> Column:
        if k + 1 == len(sets):
            return F.transform(sets[k], lambda x: fn(*given, x))
        return F.flatten(F.transform(sets[k], lambda x: go(k + 1, [*given, x])))

    return as_set(go(0, []))


def if_set(test: Column, then: Column, otherwise: Column) -> Column:
    """The conditional of sets: an empty test (null) gives the empty value, and neither branch."""
    return F.when(test.isNull(), None).when(test, then).otherwise(otherwise)


def first_nonempty(*sets: Column) -> Column:
    """The first alternative that has members (the last one if none has)."""
    out = sets[-1]
    for s in reversed(sets[:-1]):
        out = F.when(F.size(s) > 0, s).otherwise(out)
    return out


def pick_greater(s: Column, *bounds: Column) -> Column:
    """Members above the lowest bound."""
    bound = F.least(*bounds) if len(bounds) > 1 else bounds[0]
    return F.filter(s, lambda x: x > bound)


def prefer(s: Column, test) -> Column:
    """The members that pass, or all of them if none does."""
    kept = F.filter(s, test)
    return F.when(F.size(kept) > 0, kept).otherwise(s)


def avoid(s: Column, test) -> Column:
    """The members that fail, or all of them if none does."""
    return prefer(s, lambda x: ~F.coalesce(test(x), F.lit(False)))


def smallest(s: Column, key=None) -> Column:
    """The members of the least key, all that tie; members without a key are skipped."""
    key = key or (lambda x: x)
    keys = F.filter(F.transform(s, key), lambda k: k.isNotNull())
    return F.filter(s, lambda x: key(x) == F.array_min(keys))


def largest(s: Column, key=None) -> Column:
    key = key or (lambda x: x)
    keys = F.filter(F.transform(s, key), lambda k: k.isNotNull())
    return F.filter(s, lambda x: key(x) == F.array_max(keys))


def fold(s: Column, start: Column, step, key=None, select=None) -> Column:
    """Folds a set in sorted order: step(accumulator, item), over the keys of the selected members."""
    if select:
        s = F.filter(s, select)
    return F.aggregate(F.transform(s, key) if key else s, start, step)


def pick_n(s: Column, n: int, offset: int = 0) -> Column:
    return F.slice(s, offset + 1, n)


def sample_n(s: Column, n: int = 10, seed: int | None = None) -> Column:
    return F.slice(F.shuffle(s, seed) if seed is not None else F.shuffle(s), 1, n)


# sets of rows


def rows_union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sets).distinct()


def rows_intersection(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.intersect, sets)


def rows_difference(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(DataFrame.subtract, others, first)


def rows_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, `overlap`: whether the sets have a member in common. One member is enough to stop."""
    return a.intersect(b).limit(1).agg((F.count("*") > 0).alias("overlap"))


def members(rows: DataFrame, s: str, into: str = "member") -> DataFrame:
    return rows.select(*(c for c in rows.columns if c != s), F.explode(s).alias(into))


def collect(rows: DataFrame, keys: list[str], member: str, into: str = "members") -> DataFrame:
    """The set of each key's members."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(member)).alias(into))


def blocks(rows: DataFrame, order: list[str], block: int, into: str = "block") -> DataFrame:
    """Rows in blocks of a fixed size, in an order. Each range partition is numbered by itself and shifted by the sizes of those
    before it."""
    from lattica.plans.model import Pool, allocate_oids

    numbered = allocate_oids(rows, Pool("blocks", 0, 1 << 62), 0, order, "__place")
    return numbered.withColumn(into, F.floor(F.col("__place") / block)).drop("__place")


def overlap_join(a: DataFrame, b: DataFrame, member: str, a_key: str, b_key: str) -> DataFrame:
    """How many members each set of a shares with each set of b, for the pairs that share any: an equi-join on the member. Both
    sides hold each (key, member) once."""
    left = a.select(F.col(a_key).alias("a_key"), F.col(member).alias("m")).distinct()
    right = b.select(F.col(b_key).alias("b_key"), F.col(member).alias("n")).distinct()
    return left.join(right, F.col("m") == F.col("n")).groupBy("a_key", "b_key").agg(F.count("*").alias("shared"))


def running(rows: DataFrame, keys: list[str], order: list[Column], value: Column, into: str) -> DataFrame:
    return rows.withColumn(into, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


# conditionals: a null is the empty set, which is neither true nor false


def tryif(test: Column, *values: Column) -> Column:
    """The first of the values that is not empty, if the test holds; an empty test counts as false."""
    return F.when(F.coalesce(test, F.lit(False)), F.coalesce(*values))


def cond(*clauses: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    """The value of the first clause whose test isn't false; an empty test is not false."""
    out = None
    for test, value in clauses:
        holds = F.coalesce(test, F.lit(True))
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return out if otherwise is None else out.otherwise(otherwise)


def case(key: Column, *clauses: tuple[object, Column], otherwise: Column | None = None) -> Column:
    """The value of the first clause that has the key among its keys."""
    out = None
    for keys, value in clauses:
        test = key.isin(list(keys) if isinstance(keys, (list, tuple, set, frozenset)) else [keys])
        out = F.when(test, value) if out is None else out.when(test, value)
    return out if otherwise is None else out.otherwise(otherwise)


def when(test: Column, value: Column) -> Column:
    """The value if the test is neither false nor empty."""
    return F.when(test, value)


def unless(test: Column, value: Column) -> Column:
    """The value if the test is false; none if it is empty."""
    return F.when(~test, value)


def and_(*tests: Column) -> Column:
    """The first test that is false or empty, else the last one."""
    out = tests[-1]
    for t in reversed(tests[:-1]):
        out = F.when(t.isNull(), F.lit(None)).when(~t, F.lit(False)).otherwise(out)
    return out


def or_(*tests: Column) -> Column:
    """The first test that is neither false nor empty, else the last one."""
    out = tests[-1]
    for t in reversed(tests[:-1]):
        out = F.when(t, F.lit(True)).otherwise(out)
    return out


def not_(test: Column) -> Column:
    """Empty stays empty."""
    return ~test


def some_or_skip(s: Column, test) -> Column:
    """some(), where a member that the test fails on (null) is skipped."""
    return F.exists(s, lambda x: F.coalesce(test(x), F.lit(False)))


def every_or_skip(s: Column, test) -> Column:
    return F.forall(s, lambda x: F.coalesce(test(x), F.lit(True)))


def choice_size(rows: DataFrame, keys: list[str], member: str, into: str = "members") -> DataFrame:
    """How many different members each key has."""
    return rows.groupBy(*keys).agg(F.countDistinct(member).alias(into))
