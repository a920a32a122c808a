"""The data model: frames are 64-bit ids whose slots hold sets of typed values, kept as plain tables.

facts: one row per (oid, slot, value), duplicate free. vtype says which of vs (strings), vn (numbers), vo (ids of frames) is set.
Integers are in vn, to be compared with other numbers, and whole in vo, as a double has no room for those over 2 ** 53.
wide: one row per frame and a column per slot; a null is an empty set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTS = "oid bigint, slot string, vtype string, vs string, vn double, vo bigint"
#: Types of values, in the order in which values of different types are sorted.
TYPES = ("int", "num", "oid", "bool", "ts", "str", "sym", "bin", "json")


@dataclass(frozen=True)
class Oid:
    """The id of a frame, as a value to search for."""

    id: int


@dataclass(frozen=True)
class Pool:
    """A range of ids: base to base + capacity - 1."""

    name: str
    base: int
    capacity: int


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def value_struct(column: Column, kind: T.DataType, oid: bool = False) -> Column:
    """The typed value (vtype, vs, vn, vo) of a column."""
    if oid:
        fields = ("oid", None, None, column.cast("bigint"))
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        fields = ("int", None, column.cast("double"), column.cast("bigint"))
    elif isinstance(kind, T.NumericType):
        fields = ("num", None, column.cast("double"), None)
    elif isinstance(kind, T.BooleanType):
        fields = ("bool", column.cast("string"), None, None)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        fields = ("ts", column.cast("string"), None, None)
    elif isinstance(kind, T.BinaryType):
        fields = ("bin", F.base64(column), None, None)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        fields = ("json", F.to_json(column), None, None)
    else:
        fields = ("str", column.cast("string"), None, None)
    names, casts = ("vtype", "vs", "vn", "vo"), ("string", "string", "double", "bigint")
    return F.struct(*((F.lit(x) if x is None or isinstance(x, str) else x).cast(c).alias(n) for n, x, c in zip(names, fields, casts)))


def _entries(field: T.StructField, offset: int | None) -> Column:
    """The members of an array column, as (slot, value)."""
    kind = field.dataType.elementType

    def entry(x: Column) -> Column:
        return F.struct(F.lit(field.name).alias("slot"), value_struct(x + offset if offset else x, kind, offset is not None).alias("v"))

    return F.transform(F.array_compact(F.coalesce(F.col(field.name), F.array().cast(field.dataType))), entry)


def to_facts(wide: DataFrame, key: str, slots: Sequence[str] | None = None, oid_slots: Mapping[str, int] | Sequence[str] = (), base: int = 0) -> DataFrame:
    """A wide table as facts: one scan, one row per column that isn't null. Array columns are sets of values. oid_slots name columns
    that hold ids of frames, with the base to add to them if it is a mapping; base is added to the key."""
    offsets = dict(oid_slots) if isinstance(oid_slots, Mapping) else dict.fromkeys(oid_slots, 0)
    plain, sets, singles = [], [], []
    for field in wide.schema:
        if field.name == key or (slots is not None and field.name not in slots):
            continue
        c = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType) and not isinstance(field.dataType.elementType, (T.ArrayType, T.StructType, T.MapType)):
            sets.append(_entries(field, offsets.get(field.name)))
        else:
            off = offsets.get(field.name)
            value = value_struct(c + off if off else c, field.dataType, off is not None)
            plain.append(F.when(c.isNotNull(), F.struct(F.lit(field.name).alias("slot"), value.alias("v"))))
            singles.append((field.name, c, value))
    if len(plain) == 1 and not sets:  # one slot: a plain filter and projection, which reach the scan
        name, column, value = singles[0]
        return wide.where(column.isNotNull()).select((F.col(key).cast("bigint") + base).alias("oid"), F.lit(name).alias("slot"), *(value[f].alias(f) for f in ("vtype", "vs", "vn", "vo")))
    entries = F.array_compact(F.array(*plain)) if plain else None
    every = F.concat(*([entries] if plain else []), *sets) if sets else entries
    if every is None:
        return wide.sparkSession.createDataFrame([], FACTS)
    rows = wide.select((F.col(key).cast("bigint") + base).alias("oid"), F.explode(every).alias("e"))
    out = rows.select("oid", "e.slot", "e.v.vtype", "e.v.vs", "e.v.vn", "e.v.vo")
    return out.distinct() if sets else out


@dataclass(frozen=True)
class Source:
    """A wide table of frames: its key, the columns that hold ids of frames (with the base to add to them), and the base of the key."""

    wide: DataFrame
    key: str
    oid_slots: Mapping[str, int] | Sequence[str] = ()
    base: int = 0

    def slots(self) -> list[str]:
        return [f.name for f in self.wide.schema if f.name != self.key]

    def test(self, slots: Sequence[object], values: Sequence[object]) -> Column:
        """Whether a row has one of the values in one of the slots, as a test of its columns, which the scan can take."""
        offsets = dict(self.oid_slots) if isinstance(self.oid_slots, Mapping) else dict.fromkeys(self.oid_slots, 0)
        out = F.lit(False)
        for name in self.slots():
            if name in slots:
                out = out | _column_has(F.col(name), self.wide.schema[name].dataType, values, offsets.get(name))
        return F.coalesce(out, F.lit(False)) if len(slots) > 1 else out


@dataclass(frozen=True)
class Frames:
    """Frames that are kept in wide tables. facts() makes facts of the slots asked for, and reads no other columns."""

    sources: tuple[Source, ...]

    def facts(self, *slots: str) -> DataFrame:
        parts = []
        for s in self.sources:
            own = [x for x in s.slots() if not slots or x in slots]
            if own:
                parts.append(to_facts(s.wide, s.key, own, s.oid_slots, s.base))
        if not parts:
            return self.sources[0].wide.sparkSession.createDataFrame([], FACTS)
        return reduce(DataFrame.unionByName, parts)


def facts_of(source: DataFrame | Frames, *slots: str) -> DataFrame:
    """The facts of some slots (all if none is named), from a table of facts or from wide tables."""
    if isinstance(source, Frames):
        return source.facts(*slots)
    return source.where(F.col("slot").isin(list(slots))) if slots else source


def _column_has(c: Column, kind: T.DataType, values: Sequence[object], offset: int | None) -> Column:
    """Whether a column has one of some values; the same values that matches_any() finds in its facts."""
    if isinstance(kind, T.ArrayType):
        return F.exists(c, lambda x: F.coalesce(_column_has(x, kind.elementType, values, offset), F.lit(False)))
    flags = [v for v in values if isinstance(v, bool)]
    numbers = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    texts = [v for v in values if isinstance(v, str)]
    if offset is not None:
        return c.isin([v.id - offset for v in values if isinstance(v, Oid)])
    if isinstance(kind, T.IntegralType):
        whole = [int(v) for v in numbers if v == int(v)]
        return c.isin([v for v in whole if -(2**63) <= v < 2**63])
    if isinstance(kind, T.NumericType):
        return c.isin([float(v) for v in numbers])
    if isinstance(kind, T.BooleanType):
        return c.isin(flags)
    return c.isin(texts) if isinstance(kind, T.StringType) else c.cast("string").isin(texts)


def value_text(vtype: str = "vtype") -> Column:
    """A value as text that tells values of one type apart."""
    return F.coalesce("vs", F.col("vo").cast("string"), F.when(F.col(vtype) == "int", F.col("vn").cast("bigint").cast("string")).otherwise(F.col("vn").cast("string")))


def to_wide(facts: DataFrame, slots: Sequence[str]) -> DataFrame:
    """A row per frame, with the sorted set of each slot's values as an array of text (an empty array where it has none)."""
    pivoted = facts.where(F.col("slot").isin(list(slots))).withColumn("__v", value_text()).groupBy("oid").pivot("slot", list(slots)).agg(F.array_sort(F.collect_set("__v")))
    return pivoted.select("oid", *(F.coalesce(F.col(s), F.array().cast("array<string>")).alias(s) for s in slots))


def matches(value: object) -> Column:
    """Whether a fact's value is this one: an Oid, a number, or text."""
    if isinstance(value, Oid):
        return (F.col("vtype") == "oid") & (F.col("vo") == value.id)
    if isinstance(value, bool):
        return (F.col("vtype") == "bool") & (F.col("vs") == str(value).lower())
    if isinstance(value, int):
        return _is_integer([value])
    if isinstance(value, float):
        return F.col("vn") == value
    return F.col("vs") == str(value)


def _is_integer(values: Sequence[int]) -> Column:
    """Whether a fact's value is one of these: integers are compared whole, other numbers as doubles."""
    return F.col("vn").isin([float(v) for v in values]) & ((F.col("vtype") != "int") | F.col("vo").isNull() | F.col("vo").isin([v for v in values if -(2**63) <= v < 2**63]))


def matches_any(values: Sequence[object]) -> Column:
    """Whether a fact's value is one of these, as IN lists that reach the scan."""
    oids = [v.id for v in values if isinstance(v, Oid)]
    flags = [v for v in values if isinstance(v, bool)]
    whole = [v for v in values if isinstance(v, int) and not isinstance(v, bool)]
    numbers = [v for v in values if isinstance(v, float)]
    texts = [v for v in values if isinstance(v, str)]
    out = F.lit(False)
    for some, test in ((oids, lambda: (F.col("vtype") == "oid") & F.col("vo").isin(oids)), (whole, lambda: _is_integer(whole)), (numbers, lambda: F.col("vn").isin(numbers)), (texts, lambda: F.col("vs").isin(texts))):
        if some:
            out = out | test()
    for v in flags:
        out = out | matches(v)
    return out


# ids of frames

def make_oid(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("bigint"), 32).bitwiseOR(low.cast("bigint"))


def oid_hi(oid: Column) -> Column:
    return F.shiftrightunsigned(oid, 32)


def oid_lo(oid: Column) -> Column:
    return oid.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def oid_plus(oid: Column, n: Column | int) -> Column:
    return oid + n


def oid_offset(oid: Column, base: int) -> Column:
    """How far an id is from a base."""
    return oid - F.lit(base)


def oid_base(oid: Column, modulo: int = 1 << 20) -> Column:
    """The first id of the block that an id lies in."""
    return oid - F.pmod(oid, F.lit(modulo).cast("bigint"))


def oid_string(oid: Column) -> Column:
    """`@high/low` in hexadecimal digits."""
    return F.concat(F.lit("@"), F.lower(F.hex(oid_hi(oid))), F.lit("/"), F.lower(F.hex(oid_lo(oid))))


def parse_oid(text: Column) -> Column:
    part = lambda i: F.conv(F.regexp_extract(text, r"^@([0-9A-Fa-f]+)/([0-9A-Fa-f]+)$", i), 16, 10)
    return F.when(text.rlike(r"^@[0-9A-Fa-f]+/[0-9A-Fa-f]+$"), make_oid(part(1), part(2)))


def oid_hex(oid: Column, base: int = 0) -> Column:
    return F.lower(F.hex(oid - F.lit(base)))


def hex_oid(address: Column, base: int = 0) -> Column:
    return F.conv(address, 16, 10).cast("bigint") + base


def in_pool(oid: Column, pool: Pool) -> Column:
    return oid.between(pool.base, pool.base + pool.capacity - 1)


def pool_of(rows: DataFrame, pools: Sequence[Pool], oid: str = "oid", into: str = "pool") -> DataFrame:
    """rows with the name of the pool that each id lies in (null if in none). Pools are few, and become one CASE expression."""
    name = F.lit(None).cast("string")
    for p in reversed(pools):
        name = F.when(in_pool(F.col(oid), p), p.name).otherwise(name)
    return rows.withColumn(into, name)


def pool_elements(spark: SparkSession, pool: Pool, start: int = 0, count: int | None = None) -> DataFrame:
    """The ids of a pool, or `count` of them from `start` on."""
    first = pool.base + start
    return spark.range(first, min(pool.base + pool.capacity, first + count if count is not None else pool.base + pool.capacity)).withColumnRenamed("id", "oid")


def allocate_oids(rows: DataFrame, pool: Pool, used: int, order: Sequence[str], into: str = "oid") -> DataFrame:
    """rows with new ids after the `used` ones. Each partition is numbered by itself, after a range partitioning by `order`, and
    shifted by the sizes of those before it, so that no task sees all rows."""
    from pyspark.sql import Window

    dealt = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    local = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = dealt.groupBy("__part").count()
    before = sizes.select(F.col("__part").alias("__p"), (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    joined = local.join(F.broadcast(before), F.col("__part") == F.col("__p"))  # a row per partition
    return joined.withColumn(into, F.col("__before") + F.col("__n") - 1 + F.lit(pool.base + used)).drop("__part", "__p", "__n", "__before")
