"""Search over facts: conjunctions of slot and value clauses, filters with fallbacks, indexes and federations of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.plans.model import Frames, Pool, facts_of, in_pool, matches_any

Clause = tuple[object, object]


def _list(x: object) -> list:
    return list(x) if isinstance(x, (list, tuple, set, frozenset)) else [x]


def clause(slots: object, values: object) -> Column:
    """Whether a fact bears out a clause: any of the slots with any of the values."""
    return F.col("slot").isin(_list(slots)) & matches_any(_list(values))


def find_frames(facts: DataFrame | Frames, *clauses: Clause) -> DataFrame:
    """The frames (column oid) that bear out every clause.

    Over one wide table (Frames of one source) the clauses become tests of its columns, which the scan takes. Else one scan, filtered by the clauses, and one aggregation by frame that gathers which clauses it bears out; there is no join per
    clause, and partial aggregation leaves a row per frame and task to shuffle. A clause without values has no frames, and the
    result is empty then."""
    if not clauses:
        raise ValueError("a search needs a clause")
    if any(not _list(v) or not _list(s) for s, v in clauses):
        return _no_frames(facts)
    if isinstance(facts, Frames):
        if len(facts.sources) == 1:
            only = facts.sources[0]
            tests = [only.test(_list(s), _list(v)) for s, v in clauses]
            return only.wide.where(reduce(Column.__and__, tests)).select((F.col(only.key).cast("bigint") + only.base).alias("oid")).distinct()
        facts = facts.facts(*{str(x) for s, _ in clauses for x in _list(s)})
    tests = [clause(s, v) for s, v in clauses]
    found = facts.where(reduce(Column.__or__, tests))
    if len(tests) == 1:
        return found.select("oid").distinct()
    if len(tests) > 62:
        raise ValueError("at most 62 clauses")
    borne = reduce(Column.bitwiseOR, (F.when(t, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, t in enumerate(tests)))
    return found.groupBy("oid").agg(F.bit_or(borne).alias("borne")).where(F.col("borne") == (1 << len(tests)) - 1).select("oid")


def xfind_frames(facts: DataFrame | Frames, *clauses: Clause) -> DataFrame:
    """find_frames() without the clauses that have no values."""
    kept = [c for c in clauses if _list(c[1])]
    return find_frames(facts, *kept) if kept else _no_frames(facts)


def _no_frames(facts: DataFrame | Frames) -> DataFrame:
    return (facts.facts() if isinstance(facts, Frames) else facts).select("oid").limit(0)


def federated_find(sources: Sequence[DataFrame], *clauses: Clause) -> DataFrame:
    """find_frames() over several indexes as one: a frame may bear out one clause in one and another in another."""
    return find_frames(reduce(DataFrame.unionByName, sources), *clauses)


def pick(rows: DataFrame, *tests: Column) -> DataFrame:
    """Rows that pass all tests; a null is no pass."""
    return rows.where(reduce(Column.__and__, tests))


def reject(rows: DataFrame, *tests: Column) -> DataFrame:
    """The rows that pick() leaves out."""
    return rows.where(~F.coalesce(reduce(Column.__and__, tests), F.lit(False)))


def passes(value: Column, test: object) -> Column:
    """Whether a value passes a test: a Regex that is found in a text, a Pool that holds an id, a function of the column, a tuple of
    a function and more arguments, a list or set that has the value, or a value that it equals. Nulls pass none."""
    if isinstance(test, Pool):
        out = in_pool(value, test)
    elif isinstance(test, tuple) and test and callable(test[0]):
        out = test[0](value, *test[1:])
    elif callable(test):
        out = test(value)
    elif isinstance(test, (list, set, frozenset)):
        out = reduce(Column.__or__, [passes(value, t) for t in test], F.lit(False))
    else:
        out = value == F.lit(test)
    return F.coalesce(out, F.lit(False))


def pick_where(rows: DataFrame, **tests: object) -> DataFrame:
    """Rows whose columns pass their tests (see passes()): all columns, any one of a list of tests."""
    return rows.where(reduce(Column.__and__, [passes(F.col(c), t) for c, t in tests.items()]))


def reject_where(rows: DataFrame, **tests: object) -> DataFrame:
    """The rows that pick_where() leaves out."""
    return rows.where(~reduce(Column.__and__, [passes(F.col(c), t) for c, t in tests.items()]))


def testp(facts: DataFrame, frames: DataFrame, slots: object, test: object) -> DataFrame:
    """The frames that have a value in one of the slots that passes a test: a function of the column `v` of typed values (struct
    vtype, vs, vn, vo), or a table (DataFrame with a column vs, vn or vo) that has the value."""
    values = facts_of(facts, *_list(slots))
    if isinstance(test, DataFrame):
        values = values.join(test.select(*(F.col(c).alias(f"__{c}") for c in test.columns)), reduce(Column.__and__, [F.col(c) == F.col(f"__{c}") for c in test.columns]), "left_semi")
    else:
        values = values.where(F.coalesce(test(F.struct("vtype", "vs", "vn", "vo")), F.lit(False)))
    return frames.select("oid").join(values.select("oid"), "oid", "left_semi")


def prefer(rows: DataFrame, *tests: Column) -> DataFrame:
    """pick(), or all rows if it is empty. One aggregate row that says whether any passes is joined, which needs no second pass over
    what is kept and no action while the plan is made."""
    test = F.coalesce(reduce(Column.__and__, tests), F.lit(False))
    any_pass = rows.where(test).limit(1).agg((F.count("*") > 0).alias("__any"))
    return rows.join(F.broadcast(any_pass)).where(test | ~F.col("__any")).drop("__any")


def avoid(rows: DataFrame, *tests: Column) -> DataFrame:
    """reject(), or all rows if it is empty."""
    test = F.coalesce(reduce(Column.__and__, tests), F.lit(False))
    return prefer(rows, ~test)


def pick_members(rows: DataFrame, column: str, members: DataFrame, member: str) -> DataFrame:
    """Rows whose value is in a set given as a table; Spark broadcasts the set if its size allows."""
    return rows.join(members.select(F.col(member).alias("__m")), F.col(column) == F.col("__m"), "left_semi")


def reject_members(rows: DataFrame, column: str, members: DataFrame, member: str) -> DataFrame:
    return rows.join(members.select(F.col(member).alias("__m")), F.col(column) == F.col("__m"), "left_anti")


def avoid_members(rows: DataFrame, column: str, members: DataFrame, member: str) -> DataFrame:
    """reject_members(), or all rows if it is empty."""
    marked = rows.join(members.select(F.col(member).alias("__m")).distinct(), F.col(column) == F.col("__m"), "left")
    return avoid(marked, F.col("__m").isNotNull()).drop("__m")


def pick_types(facts: DataFrame, *types: str) -> DataFrame:
    return facts.where(F.col("vtype").isin(list(types)))


def skip_types(facts: DataFrame, *types: str) -> DataFrame:
    return facts.where(~F.col("vtype").isin(list(types)))


def get(facts: DataFrame | Frames, frames: DataFrame, *slots: str) -> DataFrame:
    """The values of some slots over a set of frames, as a set (columns vtype, vs, vn, vo)."""
    return facts_of(facts, *slots).join(frames.select("oid"), "oid", "left_semi").select("vtype", "vs", "vn", "vo").distinct()


def test(facts: DataFrame | Frames, frames: DataFrame, slots: object, values: object = None) -> DataFrame:
    """The frames that have a value in one of the slots, or one of the given values."""
    has = F.col("slot").isin(_list(slots)) if values is None else clause(slots, values)
    return frames.select("oid").join(facts_of(facts, *_list(slots)).where(has).select("oid"), "oid", "left_semi")


def sumframe(facts: DataFrame | Frames, frames: DataFrame, *slots: str) -> DataFrame:
    """A record per frame: the sets of the given slots."""
    from lattica.plans.model import to_wide

    return to_wide(facts_of(facts, *slots).join(frames.select("oid"), "oid", "left_semi"), slots)


# indexes


def index_frames(facts: DataFrame | Frames, *slots: str) -> DataFrame:
    """The postings of some slots: a row per (slot, value, frame)."""
    return facts_of(facts, *slots).select("slot", "vtype", "vs", "vn", "vo", "oid").distinct()


def write_index(postings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """An index on disk: a folder per slot, sorted by value inside, so that a search reads the slot's files and skips row groups by
    their statistics."""
    postings.repartition("slot", F.pmod(F.xxhash64("vs", "vn", "vo"), F.lit(64))).sortWithinPartitions("slot", "vs", "vn", "vo").write.mode(mode).partitionBy("slot").parquet(path)


def index_keys(postings: DataFrame) -> DataFrame:
    return postings.select("slot", "vtype", "vs", "vn", "vo").distinct()


def index_sizes(postings: DataFrame) -> DataFrame:
    """How many frames each key has."""
    return postings.groupBy("slot", "vtype", "vs", "vn", "vo").agg(F.countDistinct("oid").alias("frames"))


def slot_counts(postings: DataFrame) -> DataFrame:
    """Keys and postings of each slot."""
    return index_sizes(postings).groupBy("slot").agg(F.count("*").alias("keys"), F.sum("frames").alias("postings"))


def key_histogram(postings: DataFrame) -> DataFrame:
    """How many keys have how many frames."""
    return index_sizes(postings).groupBy("frames").agg(F.count("*").alias("keys"))


def merge_indexes(*indexes: DataFrame, min_count: int = 1) -> DataFrame:
    """Several indexes as one; keys with fewer than min_count frames are left out."""
    merged = reduce(DataFrame.unionByName, indexes).distinct()
    if min_count <= 1:
        return merged
    key = ["slot", "vtype", "vs", "vn", "vo"]
    often = index_sizes(merged).where(F.col("frames") >= min_count)
    on = reduce(Column.__and__, (merged[k].eqNullSafe(often[k]) for k in key))
    return merged.join(often, on, "left_semi")


# Bloom filters


def bloom_build(rows: DataFrame, column: str, expected: int, error: float = 0.01) -> DataFrame:
    """A Bloom filter of a column as rows (word, bits) of a bit array, built by bit_or in the aggregation: its size is set by
    `expected` and `error`, not by the data. With more keys than `expected` it passes more than `error` of the others."""
    words, hashes = bloom_shape(expected, error)
    bits = rows.select(F.explode(F.array(*bloom_bits(F.col(column), words, hashes))).alias("bit"))
    return bits.groupBy(F.shiftrightunsigned("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(63).cast("int"))).alias("bits"))


def bloom_shape(expected: int, error: float) -> tuple[int, int]:
    """Words of 64 bits and hash functions for a filter."""
    import math

    bits = max(64, math.ceil(-expected * math.log(error) / math.log(2) ** 2))
    return -(-bits // 64), max(1, round(bits / max(1, expected) * math.log(2)))


def bloom_bits(c: Column, words: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(c.cast("string"), F.lit(i)), F.lit(words * 64).cast("bigint")) for i in range(hashes)]


#: Words of the largest filter that is broadcast (8 MB, some 7 million keys at an error of 0.01).
BROADCAST_WORDS = 1 << 20


def _in_bloom(rows: DataFrame, column: str, bloom: DataFrame, expected: int, error: float) -> DataFrame:
    """rows with `__in`. A filter of BROADCAST_WORDS at most is broadcast as one array of words, each at its place; of a larger one,
    the different values look up their words by joins that shuffle."""
    words, hashes = bloom_shape(expected, error)
    one = F.lit(1).cast("bigint")
    if words > BROADCAST_WORDS:
        keys = rows.select(F.col(column).alias("__key")).where("__key is not null").distinct()
        bits = keys.select("__key", F.explode(F.array(*bloom_bits(F.col("__key"), words, hashes))).alias("bit"))
        found = bits.join(bloom, F.shiftrightunsigned("bit", 6) == F.col("word")).where(F.call_function("shiftright", F.col("bits"), F.col("bit").bitwiseAND(63).cast("int")).bitwiseAND(one) == 1)
        passed = found.groupBy("__key").agg(F.count("*").alias("__set")).where(F.col("__set") == hashes).select("__key", F.lit(True).alias("__hit"))
        return rows.join(passed, F.col(column) == F.col("__key"), "left").withColumn("__in", F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")
    every = rows.sparkSession.range(words).join(bloom, F.col("id") == F.col("word"), "left")
    whole = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))).alias("w")).select(F.col("w.bits").alias("__bloom"))
    test = F.col(column).isNotNull()
    for bit in bloom_bits(F.col(column), words, hashes):
        word = F.get("__bloom", F.shiftrightunsigned(bit, 6).cast("int"))
        test = test & (F.call_function("shiftright", word, bit.bitwiseAND(63).cast("int")).bitwiseAND(one) == 1)
    return rows.join(F.broadcast(whole)).withColumn("__in", test).drop("__bloom")


def bloom_check(rows: DataFrame, column: str, bloom: DataFrame, expected: int, error: float = 0.01) -> DataFrame:
    """The rows that may be in the filter: none that is in it is lost. Nulls are in no filter."""
    return _in_bloom(rows, column, bloom, expected, error).where("__in").drop("__in")


def bloom_hits(rows: DataFrame, column: str, bloom: DataFrame, by: Sequence[str], expected: int, error: float = 0.01) -> DataFrame:
    """How many rows there are for each key, and how many of them may be in the filter: columns of the key, n, hits."""
    return _in_bloom(rows, column, bloom, expected, error).groupBy(*by).agg(F.count("*").alias("n"), F.count_if("__in").alias("hits"))
