"""Computed slots: rules that give a slot's values from other facts, resolved when the plan is made."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.graph import closure, edges_of

VALUE = ["vtype", "vs", "vn", "vo"]
#: A rule: (facts, rules, slots under way) -> (oid, vtype, vs, vn, vo).
Rule = Callable[[DataFrame, "Rules", frozenset], DataFrame]


def stored(facts: DataFrame, slot: str) -> DataFrame:
    return facts.where(F.col("slot") == slot).select("oid", *VALUE)


def inverse(of: str) -> Rule:
    """Stored values, and the frames that have this one in the slot `of`. Needs to know the slot's own name: see Rules.define."""
    return lambda facts, rules, busy: facts.where((F.col("slot") == of) & (F.col("vtype") == "oid")).select(F.col("vo").alias("oid"), F.lit("oid").alias("vtype"), F.lit(None).cast("string").alias("vs"), F.lit(None).cast("double").alias("vn"), F.col("oid").alias("vo"))


def inherited(slot: str, through: str) -> Rule:
    """The slot's values at every frame reached over `through`, the frame itself among them."""

    def rule(facts: DataFrame, rules: Rules, busy: frozenset) -> DataFrame:
        own = rules.values(facts, slot, busy) if slot not in busy else stored(facts, slot)
        walk = closure(edges_of(facts, through), facts.select("oid").distinct())
        return walk.join(own.withColumnRenamed("oid", "node"), "node").select(F.col("root").alias("oid"), *VALUE)

    return rule


def multi(*slots: str) -> Rule:
    """The union of several slots."""
    return lambda facts, rules, busy: reduce(DataFrame.union, [rules.values(facts, s, busy) for s in slots])


def star(*slots: str) -> Rule:
    """Closure over slots, with the frame itself."""

    def rule(facts: DataFrame, rules: Rules, busy: frozenset) -> DataFrame:
        walk = closure(edges_of(facts, *slots), facts.select("oid").distinct())
        return walk.select(F.col("root").alias("oid"), F.lit("oid").alias("vtype"), F.lit(None).cast("string").alias("vs"), F.lit(None).cast("double").alias("vn"), F.col("node").alias("vo"))

    return rule


def plus(*slots: str) -> Rule:
    """Closure over slots without the frame itself."""

    def rule(facts: DataFrame, rules: Rules, busy: frozenset) -> DataFrame:
        return star(*slots)(facts, rules, busy).where("vo <> oid")

    return rule


def keyed(slot: str, key: str) -> Rule:
    """The entry of a key in the slot's values, which are JSON objects: {"k": 1} gives 1 for the key k."""

    def rule(facts: DataFrame, rules: Rules, busy: frozenset) -> DataFrame:
        got = F.get_json_object("vs", f"$.{key}")
        number = F.expr(f"try_cast(get_json_object(vs, '$.{key}') as double)")
        rows = rules.values(facts, slot, busy).where(got.isNotNull())
        return rows.select("oid", F.when(number.isNotNull(), "num").otherwise("str").alias("vtype"), F.when(number.isNull(), got).alias("vs"), number.alias("vn"), F.lit(None).cast("bigint").alias("vo"))

    return rule


def first_of_pair(slot: str) -> Rule:
    """The first component of the slot's values, which are JSON arrays."""

    def rule(facts: DataFrame, rules: Rules, busy: frozenset) -> DataFrame:
        got = F.get_json_object("vs", "$[0]")
        return rules.values(facts, slot, busy).where(got.isNotNull()).select("oid", F.lit("str").alias("vtype"), got.alias("vs"), F.lit(None).cast("double").alias("vn"), F.lit(None).cast("bigint").alias("vo"))

    return rule


class Rules:
    """Which slots are computed, and how. A slot that needs itself while it is computed has only its stored values there."""

    def __init__(self) -> None:
        self._rules: dict[str, list[Rule]] = {}

    def define(self, slot: str, *rules: Rule) -> Rules:
        self._rules.setdefault(slot, []).extend(rules)
        return self

    def values(self, facts: DataFrame, slot: str, busy: frozenset = frozenset()) -> DataFrame:
        """oid, vtype, vs, vn, vo of a slot: what is stored and what the rules add, as a set."""
        own = stored(facts, slot)
        if slot in busy or slot not in self._rules:
            return own
        parts = [rule(facts, self, busy | {slot}) for rule in self._rules[slot]]
        return reduce(DataFrame.union, parts, own).distinct()


def with_adjunct(wide: DataFrame, adjunct: DataFrame, key: str, adjunct_key: str) -> DataFrame:
    """A table with the columns of an adjunct, which keeps some slots of its frames elsewhere: one row of each at most."""
    return wide.join(adjunct.withColumnRenamed(adjunct_key, key), key, "left")


def register(known: DataFrame, wanted: DataFrame, keys: list[str], pool_base: int) -> DataFrame:
    """One frame for each key: those known keep their oid, new ones get the next ones, in order of the keys."""
    from lattica.plans.model import Pool, allocate_oids

    new = wanted.select(*keys).distinct().join(known.select(*keys), keys, "left_anti")
    used = known.agg(F.coalesce(F.max("oid") + 1 - pool_base, F.lit(0))).first()[0]
    return known.select(*keys, "oid").union(allocate_oids(new, Pool("registry", pool_base, 1 << 40), used, keys).select(*keys, "oid"))
