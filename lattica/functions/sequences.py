"""Sequences: arrays and texts, with offsets from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elt(a: Column, i: int) -> Column:
    return F.get(a, i)


def slice_(a: Column, start: int, end: int | None = None) -> Column:
    """start up to end; a negative end counts from the end, and start may not be negative."""
    if start < 0:
        raise ValueError("start is negative")
    stop = F.size(a) if end is None else F.size(a) + end if end < 0 else F.least(F.lit(end), F.size(a))
    return F.slice(a, F.lit(start + 1), F.greatest(stop - start, F.lit(0)))


def slice_text(s: Column, start: int, end: int | None = None) -> Column:
    stop = F.length(s) if end is None else F.length(s) + end if end < 0 else F.lit(end)
    return F.substring(s, F.lit(start + 1), F.greatest(stop - start, F.lit(0)))


def position(a: Column, x: Column) -> Column:
    """Offset of the first equal element, null if there is none."""
    at = F.array_position(a, x)
    return F.when(at > 0, at - 1)


def rposition(a: Column, x: Column) -> Column:
    """Offset of the last equal element."""
    at = F.array_position(F.reverse(a), x)
    return F.when(at > 0, F.size(a) - at)


def _offsets(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))


def position_if(a: Column, test) -> Column:
    return F.get(F.filter(_offsets(a), lambda i: test(F.get(a, i))), 0)


def find_if(a: Column, test) -> Column:
    return F.get(F.filter(a, test), 0)


def search(a: Column, part: Column) -> Column:
    """Offset at which a subsequence first stands, null if nowhere."""
    return F.get(F.filter(_offsets(a), lambda i: F.slice(a, i + 1, F.size(part)) == part), 0)


def search_text(s: Column, part: str) -> Column:
    at = F.instr(s, part)
    return F.when(at > 0, at - 1)


def remove(a: Column, x: Column) -> Column:
    return F.array_remove(a, x)


def remove_if(a: Column, test) -> Column:
    return F.filter(a, lambda x: ~F.coalesce(test(x), F.lit(False)))


def rest(a: Column, n: int = 1) -> Column:
    return F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0)))


def tail_from(a: Column, x: Column) -> Column:
    """The sequence from the first equal element on, null if there is none."""
    at = F.array_position(a, x).cast("int")
    return F.when(at > 0, F.slice(a, at, F.size(a) - at + 1))


def starts_with(a: Column, prefix: Column, start: int = 0) -> Column:
    return F.slice(a, F.lit(start + 1), F.size(prefix)) == prefix


def reduce_(a: Column, step, start: Column | None = None) -> Column:
    """A fold from the left: step(item, accumulator); without a start, the first element is it."""
    turned = lambda acc, x: step(x, acc)
    return F.aggregate(a, start, turned) if start is not None else F.aggregate(rest(a), F.get(a, 0), turned)


def map_(fn, *arrays: Column) -> Column:
    """fn over the elements of one array, or of two side by side as far as both go."""
    if len(arrays) == 1:
        return F.transform(arrays[0], fn)
    a, b = arrays
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), fn)


def sorted_by(a: Column, key, reverse: bool = False) -> Column:
    """Sorted by a key, elements of one key in their order."""
    keyed = F.transform(a, lambda x, i: F.struct(key(x).alias("k"), (-i if reverse else i).alias("i"), x.alias("x")))
    out = F.sort_array(keyed, asc=not reverse)
    return F.transform(out, lambda e: e["x"])


def set_at(a: Column, i: int, x: Column) -> Column:
    return F.transform(a, lambda y, k: F.when(k == i, x).otherwise(y))


def typed(a: Column, kind: str) -> Column:
    """As a vector of short, int, long, float or double numbers."""
    return a.cast({"short": "array<smallint>", "int": "array<int>", "long": "array<bigint>", "float": "array<float>", "double": "array<double>"}[kind])


def assoc(pairs: Column, key: Column) -> Column:
    """The first entry of a key in an array of structs (key, value)."""
    return F.get(F.filter(pairs, lambda p: p["key"] == key), 0)


#: Length tests by their sign.
_LENGTH = {"=": Column.__eq__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def length_is(a: Column, sign: str, n: int) -> Column:
    """A length compared with a number: sign is one of = < <= > >=."""
    return _LENGTH[sign](F.size(a), F.lit(n))


def every(a: Column, test) -> Column:
    """Whether all elements pass; true of an empty sequence."""
    return F.forall(a, lambda x: F.coalesce(test(x), F.lit(False)))


def some(a: Column, test) -> Column:
    return F.exists(a, lambda x: F.coalesce(test(x), F.lit(False)))


def find(a: Column, x: Column) -> Column:
    """The first equal element, null if there is none."""
    return F.when(F.array_contains(a, x), x)


def _fails(test):
    return lambda x: ~F.coalesce(test(x), F.lit(False))


def find_if_not(a: Column, test) -> Column:
    return find_if(a, _fails(test))


def position_if_not(a: Column, test) -> Column:
    return position_if(a, _fails(test))


def remove_if_not(a: Column, test) -> Column:
    return F.filter(a, lambda x: F.coalesce(test(x), F.lit(False)))


def append(*arrays: Column) -> Column:
    return F.concat(*arrays)


def reverse(a: Column) -> Column:
    return F.reverse(a)


def cons(x: Column, a: Column) -> Column:
    return F.array_prepend(a, x)


def make_vector(n: int, x: Column) -> Column:
    return F.array_repeat(x, n)


def map_to_set(fn, a: Column) -> Column:
    """The set of what fn gives for the elements, without nulls."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(a, fn))))


def elements(a: Column, start: int = 0, end: int | None = None) -> Column:
    """The set of the elements from start up to end."""
    part = a if start == 0 and end is None else slice_(a, start, end)
    return F.array_sort(F.array_distinct(F.array_compact(part)))


def text_to_vector(s: Column) -> Column:
    """The characters of a text."""
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def vector_to_text(a: Column) -> Column:
    return F.array_join(a, "")


def text_to_packet(s: Column) -> Column:
    """The bytes of a text, as numbers."""
    h = F.hex(F.encode(s, "UTF-8"))
    at = F.when(F.length(h) > 0, F.sequence(F.lit(1), F.length(h), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substr(h, i, F.lit(2)), 16, 10).cast("int"))


def sorted_lexically(a: Column) -> Column:
    """Texts in lower-case order, those alike in their own order."""
    return sorted_by(a, lambda x: F.struct(F.lower(x).alias("l"), x.alias("x")))
