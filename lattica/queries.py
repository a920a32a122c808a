"""The registered queries: each shows one operator or family on the test tables, with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import fuzzy, maps, pattern, sequences, strings, text, time
from lattica.functions import math as numbers
from lattica.operators import aggregate, geo, graph, infer, search, sets, store
from lattica.plans import model
from lattica.plans.model import Frames, Oid, Pool, Source, to_facts
from lattica.sources import io
from lattica.streaming import engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Where the ids of nations, regions and orders begin; those of customers and parts are their keys.
NATION, REGION, ORDER = 1_000_000_000, 2_000_000_000, 3_000_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return model.table(spark, sf_dir, name)


def customers(spark: SparkSession, sf_dir: str) -> Frames:
    return Frames((Source(read(spark, sf_dir, "customer"), "c_custkey", {"c_nationkey": NATION}),))


def world(spark: SparkSession, sf_dir: str) -> Frames:
    nations = Source(read(spark, sf_dir, "nation"), "n_nationkey", {"n_regionkey": REGION}, NATION)
    return Frames((*customers(spark, sf_dir).sources, nations, Source(read(spark, sf_dir, "region"), "r_regionkey", base=REGION)))


def customer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_facts(read(spark, sf_dir, "customer"), "c_custkey", oid_slots={"c_nationkey": NATION})


def world_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = to_facts(read(spark, sf_dir, "nation"), "n_nationkey", oid_slots={"n_regionkey": REGION}, base=NATION)
    regions = to_facts(read(spark, sf_dir, "region"), "r_regionkey", base=REGION)
    return customer_facts(spark, sf_dir).unionByName(nations).unionByName(regions)


def tree_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a graph: key k points to k div 2, and 0 to 5, which closes a cycle."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("oid"), F.col("p_name"), F.col("p_size"))
    up = part.select("oid", F.lit("parent").alias("slot"), F.lit("oid").alias("vtype"), F.lit(None).cast("string").alias("vs"), F.lit(None).cast("double").alias("vn"), F.when(F.col("oid") == 0, 5).otherwise(F.floor(F.col("oid") / 2)).cast("bigint").alias("vo"))
    return up.union(to_facts(part, "oid"))


TREE = "with recursive edge as (select p_partkey as src, case when p_partkey = 0 then 5 else p_partkey // 2 end as dst from part)"


def oids(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "oid bigint")


# search


@query("select c_custkey as oid from customer where c_mktsegment = 'BUILDING'")
def find_frames_single(spark, sf_dir):
    return search.find_frames(customers(spark, sf_dir), ("c_mktsegment", "BUILDING"))


@query("select c_custkey as oid from customer where c_mktsegment in ('BUILDING', 'FURNITURE')")
def find_frames_or(spark, sf_dir):
    return search.find_frames(customer_facts(spark, sf_dir), ("c_mktsegment", ["BUILDING", "FURNITURE"]))


@query("select c_custkey as oid from customer where c_mktsegment in ('BUILDING', 'FURNITURE') and c_nationkey in (1, 2, 3, 7)")
def find_frames_and(spark, sf_dir):
    return search.find_frames(customers(spark, sf_dir), ("c_mktsegment", ["BUILDING", "FURNITURE"]), ("c_nationkey", [Oid(NATION + k) for k in (1, 2, 3, 7)]))


@query("select 1000000000 + n_nationkey as oid from nation where n_name in ('ASIA', 'CHINA', 'FRANCE') union select 2000000000 + r_regionkey from region where r_name in ('ASIA', 'CHINA', 'FRANCE')")
def find_frames_any_slot(spark, sf_dir):
    return search.find_frames(world(spark, sf_dir), (["n_name", "r_name"], ["ASIA", "CHINA", "FRANCE"]))


@query("select c_custkey as oid from customer where c_mktsegment = 'MACHINERY'")
def xfind_frames(spark, sf_dir):
    return search.xfind_frames(customer_facts(spark, sf_dir), ("c_mktsegment", "MACHINERY"), ("c_nationkey", []))


@query("select c_custkey as oid from customer where false")
def find_frames_empty_clause(spark, sf_dir):
    return search.find_frames(customer_facts(spark, sf_dir), ("c_mktsegment", "MACHINERY"), ("c_nationkey", []))


@query("select c_custkey as oid from customer where c_mktsegment = 'BUILDING' and c_nationkey = 4")
def federated_find(spark, sf_dir):
    facts = customer_facts(spark, sf_dir)
    return search.federated_find([facts.where("slot = 'c_mktsegment'"), facts.where("slot <> 'c_mktsegment'")], ("c_mktsegment", "BUILDING"), ("c_nationkey", Oid(NATION + 4)))


@query("select c_custkey, c_name from customer where c_acctbal > 5000 and c_mktsegment in ('BUILDING', 'MACHINERY')")
def pick_slot_value(spark, sf_dir):
    return search.pick(read(spark, sf_dir, "customer"), F.col("c_acctbal") > 5000, F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where not coalesce(c_acctbal > 5000 and c_mktsegment in ('BUILDING', 'MACHINERY'), false)")
def reject_slot_value(spark, sf_dir):
    return search.reject(read(spark, sf_dir, "customer"), F.col("c_acctbal") > 5000, F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_name")


@query("select s_suppkey, s_name from supplier")
def prefer_fallback(spark, sf_dir):
    return search.prefer(read(spark, sf_dir, "supplier"), F.col("s_acctbal") > 1e12).select("s_suppkey", "s_name")


@query("select s_suppkey, s_name from supplier where s_acctbal > 0")
def prefer_kept(spark, sf_dir):
    return search.prefer(read(spark, sf_dir, "supplier"), F.col("s_acctbal") > 0).select("s_suppkey", "s_name")


@query("select s_suppkey, s_name from supplier")
def avoid_fallback(spark, sf_dir):
    return search.avoid(read(spark, sf_dir, "supplier"), F.col("s_acctbal") < 1e12).select("s_suppkey", "s_name")


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def pick_hashset(spark, sf_dir):
    members = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return search.pick_members(read(spark, sf_dir, "orders"), "o_custkey", members, "c_custkey").select("o_orderkey")


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def reject_hashset(spark, sf_dir):
    members = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return search.reject_members(read(spark, sf_dir, "orders"), "o_custkey", members, "c_custkey").select("o_orderkey")


@query("select o_orderkey from orders")
def avoid_hashset(spark, sf_dir):
    return search.avoid_members(read(spark, sf_dir, "orders"), "o_custkey", read(spark, sf_dir, "customer"), "c_custkey").select("o_orderkey")


@query("select vtype, count(*) as n from (select 'int' as vtype from part where p_size is not null union all select 'num' from part where p_retailprice is not null) group by 1")
def pick_types(spark, sf_dir):
    return search.pick_types(to_facts(read(spark, sf_dir, "part"), "p_partkey"), "int", "num").groupBy("vtype").agg(F.count("*").alias("n"))


@query("select 'str' as vtype, (select count(p_name) + count(p_brand) + count(p_type) from part) as n")
def skip_types(spark, sf_dir):
    return search.skip_types(to_facts(read(spark, sf_dir, "part"), "p_partkey"), "int", "num").groupBy("vtype").agg(F.count("*").alias("n"))


@query("select distinct c_mktsegment as v from customer where c_acctbal > 9000 union select distinct c_name from customer where c_acctbal > 9000")
def get_slot_values(spark, sf_dir):
    facts = customer_facts(spark, sf_dir)
    frames = facts.where("slot = 'c_acctbal' and vn > 9000").select("oid")
    return search.get(facts, frames, "c_mktsegment", "c_name").select(F.col("vs").alias("v"))


@query("select c_custkey as oid from customer where c_custkey in (select o_custkey from orders) and c_mktsegment in ('BUILDING', 'AUTOMOBILE')")
def test_slot_values(spark, sf_dir):
    buyers = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("oid")).distinct()
    return search.test(customer_facts(spark, sf_dir), buyers, "c_mktsegment", ["BUILDING", "AUTOMOBILE"])


@query("select c_custkey as oid, c_mktsegment as segment, (1000000000 + c_nationkey)::varchar as nation from customer")
def sumframe(spark, sf_dir):
    out = search.sumframe(customer_facts(spark, sf_dir), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("oid")), "c_mktsegment", "c_nationkey")
    return out.select("oid", F.array_join("c_mktsegment", ",").alias("segment"), F.array_join("c_nationkey", ",").alias("nation"))


@query("select c_custkey as start, r_name as v from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def getpath_3hop(spark, sf_dir):
    facts = world(spark, sf_dir)
    return graph.getpath(facts, facts.facts("c_mktsegment").select("oid"), ["c_nationkey", "n_regionkey", "r_name"]).select("start", F.col("vs").alias("v"))


@query("""select c_custkey, c_name, round(sum(o_totalprice), 2) as total from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join orders on o_custkey = c_custkey
where c_mktsegment in ('FURNITURE', 'BUILDING') and r_name = 'ASIA' group by all order by total desc, c_custkey limit 10""")
def flagship(spark, sf_dir):
    """Search, path, counter and top-k in one plan."""
    facts = world(spark, sf_dir)
    found = search.find_frames(customers(spark, sf_dir), ("c_mktsegment", ["FURNITURE", "BUILDING"]))
    asian = graph.getpath(facts, found, ["c_nationkey", "n_regionkey", "r_name"]).where("vs = 'ASIA'").select(F.col("start").alias("c_custkey"))
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(asian, F.col("o_custkey") == F.col("c_custkey"))
    totals = aggregate.increment(orders, ["c_custkey"], F.col("o_totalprice")).withColumn("total", F.round("total", 2))
    top = aggregate.pick_max(totals, 10, F.col("total"), ["c_custkey"])
    return top.join(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", "c_name", "total")


# indexes


@query("select 'c_mktsegment' as slot, c_mktsegment as v, count(*) as frames from customer group by 2 union all select 'c_nationkey', (1000000000 + c_nationkey)::varchar, count(*) from customer group by 2")
def index_sizes(spark, sf_dir):
    postings = search.index_frames(customers(spark, sf_dir), "c_mktsegment", "c_nationkey")
    return search.index_sizes(postings).select("slot", model.value_text().alias("v"), "frames")


@query("select distinct 'p_brand' as slot, p_brand as v from part union all select distinct 'p_size', p_size::varchar from part")
def index_keys(spark, sf_dir):
    return search.index_keys(search.index_frames(to_facts(read(spark, sf_dir, "part"), "p_partkey"), "p_brand", "p_size")).select("slot", model.value_text().alias("v"))


@query("select 'p_brand' as slot, count(distinct p_brand) as keys, count(*) as postings from part union all select 'p_size', count(distinct p_size), count(*) from part")
def slot_counts(spark, sf_dir):
    return search.slot_counts(search.index_frames(to_facts(read(spark, sf_dir, "part"), "p_partkey"), "p_brand", "p_size"))


@query("select frames, count(*) as keys from (select p_size, count(*) as frames from part group by 1) group by 1")
def index_histogram(spark, sf_dir):
    return search.key_histogram(search.index_frames(to_facts(read(spark, sf_dir, "part"), "p_partkey"), "p_size"))


@query("select p_partkey as oid, p_size::varchar as v from part where p_size in (select p_size from part group by 1 having count(*) >= 40)")
def merge_index_min_count(spark, sf_dir):
    facts = to_facts(read(spark, sf_dir, "part"), "p_partkey")
    halves = [search.index_frames(facts.where(f"pmod(oid, 2) = {k}"), "p_size") for k in (0, 1)]
    return search.merge_indexes(*halves, min_count=40).select("oid", model.value_text().alias("v"))


@query("with m as (select c_custkey from customer where c_acctbal > 8000) select count(*) filter (o_custkey in (select c_custkey from m)) as members, true as few_others from orders")
def bloom_check(spark, sf_dir):
    """How many orders of members a Bloom filter passes (all of them), and whether it passes at most 3 % of the others."""
    keys = read(spark, sf_dir, "customer").where("c_acctbal > 8000").select("c_custkey")
    orders, expected = read(spark, sf_dir, "orders"), max(20_000, keys.count())
    passed = search.bloom_check(orders, "o_custkey", search.bloom_build(keys, "c_custkey", expected, 0.01), expected, 0.01)
    of = lambda rows: rows.join(keys.withColumn("m", F.lit(True)), F.col("o_custkey") == F.col("c_custkey"), "left").agg(F.count("m").alias("members"), F.count_if(F.col("m").isNull()).alias("others"))
    got, every = of(passed), of(orders).select(F.col("others").alias("all_others"))
    return got.join(F.broadcast(every)).select("members", (F.col("others") <= 0.03 * F.col("all_others")).alias("few_others"))  # a row each


@query("select case when c_acctbal > 8000 then 'in' else 'out' end as kind, count(*) as n, true as as_expected from customer group by 1")
def bloom_hits(spark, sf_dir):
    """How many keys a filter has (all that were put in, few of the others)."""
    customers = read(spark, sf_dir, "customer").withColumn("kind", F.when(F.col("c_acctbal") > 8000, "in").otherwise("out"))
    keys = customers.where("kind = 'in'").select("c_custkey")
    expected = max(20_000, keys.count())
    bloom = search.bloom_build(keys, "c_custkey", expected, 0.01)
    per = search.bloom_hits(customers, "c_custkey", bloom, ["kind"], expected, 0.01)
    return per.select("kind", "n", F.when(F.col("kind") == "in", F.col("hits") == F.col("n")).otherwise(F.col("hits") <= 0.03 * F.col("n")).alias("as_expected"))


@query("select c_custkey as oid, '@0/' || lower(printf('%X', c_custkey)) as name, '@1/' || lower(printf('%X', c_custkey)) as high, c_custkey // 1024 * 1024 as base from customer")
def oid_arithmetic(spark, sf_dir):
    oid = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(oid.alias("oid"), model.oid_string(oid).alias("name"), model.oid_string(model.make_oid(F.lit(1), oid)).alias("high"), model.oid_base(oid, 1024).alias("base"))


@query("select c_custkey as oid, case when c_custkey < 500 then 'first' when c_custkey between 1000 and 1199 then 'second' end as pool from customer")
def oid_pool(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("oid"))
    return model.pool_of(rows, [Pool("first", 0, 500), Pool("second", 1000, 200)])


@query("select c_name, 7000000 + row_number() over (order by c_name) - 1 as oid from customer")
def allocate_oids(spark, sf_dir):
    return model.allocate_oids(read(spark, sf_dir, "customer").select("c_name"), Pool("names", 7_000_000, 1 << 20), 0, ["c_name"])


# sets


@query("select l_partkey as v from lineitem where l_returnflag = 'R' union select l_partkey from lineitem where l_returnflag = 'A'")
def set_union(spark, sf_dir):
    return sets.rows_union(*(_flagged(spark, sf_dir, f) for f in "RA"))


@query("select l_partkey as v from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A' intersect select l_partkey from lineitem where l_returnflag = 'N'")
def set_intersection(spark, sf_dir):
    return sets.rows_intersection(*(_flagged(spark, sf_dir, f) for f in "RAN"))


@query("select l_suppkey * 1000 + l_quantity::bigint as v from lineitem where l_returnflag = 'N' except select l_suppkey * 1000 + l_quantity::bigint from lineitem where l_returnflag = 'A'")
def set_difference(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    side = lambda f: line.where(F.col("l_returnflag") == f).select((F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("bigint")).alias("v"))
    return sets.rows_difference(side("N"), side("A"))


def _flagged(spark, sf_dir, flag):
    return read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("v"))


@query("select exists (select l_partkey from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A') as overlap")
def overlaps(spark, sf_dir):
    return sets.rows_overlap(_flagged(spark, sf_dir, "R"), _flagged(spark, sf_dir, "A"))


@query("select l_returnflag, count(distinct l_partkey) as members from lineitem group by 1")
def choice_size(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("members"))


def _order_sets(spark, sf_dir):
    """The suppliers (modulo 7) of the first and of the other lines of each order, as two sets."""
    line = read(spark, sf_dir, "lineitem").withColumn("m", F.col("l_suppkey") % 7)
    pick = lambda t: sets.as_set(F.collect_set(F.when(t, F.col("m"))))
    return line.groupBy("l_orderkey").agg(pick(F.col("l_linenumber") <= 2).alias("a"), pick(F.col("l_linenumber") > 2).alias("b"))


ORDER_SETS = """with s as (select l_orderkey, coalesce(list_sort(list(distinct l_suppkey % 7) filter (l_linenumber <= 2)), []) as a, coalesce(list_sort(list(distinct l_suppkey % 7) filter (l_linenumber > 2)), []) as b from lineitem group by 1)"""


@query(ORDER_SETS + """ select l_orderkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') as u, array_to_string(list_sort(list_intersect(a, b)), ',') as i, array_to_string(list_filter(a, lambda x: not list_contains(b, x)), ',') as d from s""")
def array_set_operations(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    show = lambda s: F.array_join(s.cast("array<string>"), ",")
    return _order_sets(spark, sf_dir).select("l_orderkey", show(sets.union(a, b)).alias("u"), show(sets.intersection(a, b)).alias("i"), show(sets.difference(a, b)).alias("d"))


@query(ORDER_SETS + """ select l_orderkey, len(a) = 0 as none, len(a) = 1 as one, len(a) > 1 as many, case when len(a) = 1 then a[1] end as single, len(list_intersect(a, b)) > 0 as shared,
 len(list_filter(b, lambda x: not list_contains(a, x))) = 0 as holds, case when len(a) <= 1 then len(a) else 0 end as at_most, case when len(a) > 1 and len(a) >= 2 then len(a) else 0 end as at_least, a = b as same from s""")
def cardinality_predicates(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _order_sets(spark, sf_dir).select("l_orderkey", sets.is_empty(a).alias("none"), sets.is_unique(a).alias("one"), sets.is_ambiguous(a).alias("many"), sets.singleton(a).alias("single"), sets.overlaps(a, b).alias("shared"), sets.contains(a, b).alias("holds"), F.size(sets.choice_max(a, 1)).alias("at_most"), F.size(sets.choice_min(a, 2)).alias("at_least"), sets.identical(a, b).alias("same"))


@query(ORDER_SETS + """ select l_orderkey, len(list_filter(a, lambda x: x > 4)) > 0 as some_big, len(list_filter(a, lambda x: x <= 4)) = 0 as all_big, len(list_filter(b, lambda x: x > 2)) as above, case when len(list_filter(a, lambda x: x > 4)) > 0 then len(list_filter(a, lambda x: x > 4)) else len(a) end as preferred from s""")
def set_quantifiers(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _order_sets(spark, sf_dir).select("l_orderkey", sets.some(a, lambda x: x > 4).alias("some_big"), sets.every(a, lambda x: x > 4).alias("all_big"), F.size(sets.pick_greater(b, F.lit(5), F.lit(2))).alias("above"), F.size(sets.prefer(a, lambda x: x > 4)).alias("preferred"))


@query(ORDER_SETS + """ select l_orderkey, (select array_to_string(list_sort(list(distinct x * 10 + y)), ',') from (select unnest(a) as x), (select unnest(b) as y)) as p from s where len(a) > 0 and len(b) > 0""")
def product_application(spark, sf_dir):
    """A function of two arguments applied to sets: its values on the product."""
    out = _order_sets(spark, sf_dir).select("l_orderkey", sets.apply(lambda x, y: x * 10 + y, F.col("a"), F.col("b")).alias("p"))
    return out.where(F.size("p") > 0).select("l_orderkey", F.array_join(F.col("p").cast("array<string>"), ",").alias("p"))


@query(ORDER_SETS + """ select l_orderkey, case when len(a) > 0 then a[1] end as low, case when len(a) > 0 then a[-1] end as high, list_sum(a)::bigint as total, len(case when len(b) > 0 then b else a end) as tried from s""")
def set_folds(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    total = F.when(F.size(a) > 0, sets.fold(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x))
    return _order_sets(spark, sf_dir).select("l_orderkey", F.get(sets.smallest(a), 0).alias("low"), F.get(sets.largest(a), 0).alias("high"), total.alias("total"), F.size(sets.first_nonempty(b, a)).alias("tried"))


@query("select l_orderkey, unnest(list_sort(list(distinct l_suppkey))) as member from lineitem group by 1")
def set_members(spark, sf_dir):
    collected = sets.collect(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey")
    return sets.members(collected, "members")


@query("""with m as (select distinct l_returnflag || l_linestatus as k, l_partkey % 500 as m from lineitem) select a.k as a_key, b.k as b_key, count(*) as shared from m a join m b on a.m = b.m group by 1, 2""")
def overlap_join(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("k"), (F.col("l_partkey") % 500).alias("m"))
    return sets.overlap_join(rows, rows, "m", "k", "k")


@query("select block, count(*) as n, min(s_suppkey) as first, max(s_suppkey) as last from (select s_suppkey, (row_number() over (order by s_suppkey) - 1) // 16 as block from supplier) group by 1")
def set_blocks(spark, sf_dir):
    return sets.blocks(read(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"], 16).groupBy("block").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"), F.max("s_suppkey").alias("last"))


@query("select range as v from range(20, 40)")
def number_range(spark, sf_dir):
    return spark.range(20, 40).select(F.col("id").alias("v"))


# counters and top-k


@query("select o_custkey, round(sum(o_totalprice), 2) as total from orders group by 1")
def table_increment(spark, sf_dir):
    return aggregate.increment(read(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_totalprice")).withColumn("total", F.round("total", 2))


@query("select o_custkey, count(*) as total from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0) group by 1")
def table_increment_existing(spark, sf_dir):
    keys = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return aggregate.increment(read(spark, sf_dir, "orders"), ["o_custkey"], existing=keys)


@query("select l_orderkey, round(product(1 + l_tax), 6) as product from lineitem group by 1")
def table_multiply(spark, sf_dir):
    return aggregate.multiply(read(spark, sf_dir, "lineitem"), ["l_orderkey"], 1 + F.col("l_tax")).withColumn("product", F.round("product", 6))


@query("select l_suppkey, max(l_extendedprice) as greatest from lineitem group by 1")
def table_maximize(spark, sf_dir):
    return aggregate.maximize(read(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_extendedprice"))


@query("select l_suppkey, min(l_extendedprice) as least from lineitem group by 1")
def table_minimize(spark, sf_dir):
    return aggregate.minimize(read(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_extendedprice"))


@query("with t as (select p_size, count(*) as total from part group by 1) select * from t where total = (select max(total) from t)")
def table_max_ties(spark, sf_dir):
    return aggregate.table_max(aggregate.increment(read(spark, sf_dir, "part"), ["p_size"]), "total")


@query("with t as (select p_size, count(*) as total from part where p_size < 20 group by 1) select * from t where total = (select max(total) from t)")
def table_max_scope(spark, sf_dir):
    scope = spark.range(20).select(F.col("id").cast("int").alias("p_size"))
    return aggregate.table_max(aggregate.increment(read(spark, sf_dir, "part"), ["p_size"]), "total", scope, ["p_size"])


@query("with t as (select p_size, count(*) as total from part group by 1) select max(total) as top, count(*) as keys from t")
def table_maxval(spark, sf_dir):
    return aggregate.increment(read(spark, sf_dir, "part"), ["p_size"]).agg(F.max("total").alias("top"), F.count("*").alias("keys"))


@query("select o_custkey, count(*) as total from orders group by 1 having count(*) >= 15")
def table_skim(spark, sf_dir):
    return aggregate.skim(aggregate.increment(read(spark, sf_dir, "orders"), ["o_custkey"]), "total", 15)


@query("select n_nationkey, c_custkey, c_acctbal from nation join customer on c_nationkey = n_nationkey qualify rank() over (partition by n_nationkey order by c_acctbal desc) = 1")
def largest_ties(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_acctbal")
    return aggregate.largest_of(rows, ["n_nationkey"], F.col("c_acctbal"))


@query("select p_brand, p_partkey, p_size from part qualify rank() over (partition by p_brand order by p_size) = 1")
def smallest_ties(spark, sf_dir):
    return aggregate.smallest_of(read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], F.col("p_size"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def pick_max(spark, sf_dir):
    return aggregate.pick_max(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, F.col("o_totalprice"), ["o_orderkey"])


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 25")
def pick_min(spark, sf_dir):
    return aggregate.pick_min(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, F.col("o_totalprice"), ["o_orderkey"])


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders qualify place <= 3")
def top_per_group(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return aggregate.top_per_group(rows, ["o_custkey"], 3, [F.desc("o_totalprice"), F.asc("o_orderkey")]).drop("o_totalprice")


@query("select lower(p_brand) as k, p_partkey from part order by k desc, p_partkey limit 40")
def sorted_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_brand", "p_partkey")
    return aggregate.sorted_rows(rows, F.col("p_brand"), ["p_partkey"], kind="lexci", reverse=True).limit(40).select(F.lower("p_brand").alias("k"), "p_partkey")


@query("select l_returnflag, sum(l_quantity)::bigint as total, bool_or(l_discount > 0.09) as any_high, bool_and(l_tax < 0.1) as every_low, array_to_string(list_sort(list(distinct l_linenumber)), ',') as lines from lineitem group by 1")
def reduce_choice(spark, sf_dir):
    line, by = read(spark, sf_dir, "lineitem"), ["l_returnflag"]
    parts = [aggregate.reduce_choice(line, by, c, fn, into) for c, fn, into in ((F.col("l_quantity"), "sum", "total"), (F.col("l_discount") > 0.09, "any", "any_high"), (F.col("l_tax") < 0.1, "every", "every_low"), (F.col("l_linenumber"), "union", "lines"))]
    out = reduce(lambda a, b: a.join(b, by), parts)
    return out.select("l_returnflag", F.col("total").cast("bigint").alias("total"), "any_high", "every_low", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@query("select 1000000000 + c_nationkey as oid, count(*) as refs from customer group by 1 union all select 2000000000 + n_regionkey, count(*) from nation group by 1")
def count_references(spark, sf_dir):
    return aggregate.count_references(world_facts(spark, sf_dir))


@query("select event_type, count(*) as total from events group by 1")
def merge_counters(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    halves = [aggregate.increment(events.where(f"pmod(event_id, 2) = {k}"), ["event_type"]) for k in (0, 1)]
    return aggregate.merge_tables(*halves, ["event_type"], "total")


@query("select event_type, array_to_string(list_sort(list(distinct user_id % 20)), ',') as users from events group by 1")
def merge_set_tables(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("u", F.col("user_id") % 20)
    halves = [sets.collect(events.where(f"pmod(event_id, 2) = {k}"), ["event_type"], "u") for k in (0, 1)]
    out = aggregate.merge_sets(*halves, ["event_type"], "members")
    return out.select("event_type", F.array_join(F.col("members").cast("array<string>"), ",").alias("users"))


# graphs and computed slots


@query(TREE + ", w as (select src as root, src as node from edge union select w.root, e.dst from w join edge e on e.src = w.node) select root, node from w")
def closure_get_star(spark, sf_dir):
    facts = tree_facts(spark, sf_dir)
    return graph.get_star(facts, facts.select("oid").distinct(), "parent").select("root", F.col("vo").alias("node"))


@query(TREE + ", w as (select 37 as root, 37 as node union select 90, 90 union select w.root, e.dst from w join edge e on e.src = w.node) select root, node from w where node not in (37, 90)")
def kleene_plus(spark, sf_dir):
    return graph.kleene_plus(tree_facts(spark, sf_dir), oids(spark, 37, 90), ["parent"])


@query(TREE + ", w as (select p_partkey as root, p_partkey as node from part where p_partkey in (44, 91, 150) union select w.root, e.dst from w join edge e on e.src = w.node) select distinct root, p_name as v from w join part on p_partkey = node union select distinct root, root::varchar from w")
def inherit(spark, sf_dir):
    out = graph.inherit(tree_facts(spark, sf_dir), oids(spark, 44, 91, 150), ["p_name"], ["parent"])
    return out.select("root", model.value_text().alias("v"))


@query(TREE + ", w as (select src as root, src as node from edge union select w.root, e.dst from w join edge e on e.src = w.node) select root as oid from w where node = 9")
def path_exists(spark, sf_dir):
    facts = tree_facts(spark, sf_dir)
    return graph.path_exists(facts, facts.select("oid").distinct(), ["parent"], 9)


@query(TREE + ", w as (select p_partkey as root, p_partkey as node from part where p_partkey in (9, 18, 37, 41, 82, 120) union select w.root, e.dst from w join edge e on e.src = w.node) select distinct root as oid from w a where not exists (select 1 from w b where b.node = a.root and b.root <> a.root)")
def basis(spark, sf_dir):
    return graph.basis(tree_facts(spark, sf_dir), oids(spark, 9, 18, 37, 41, 82, 120), ["parent"])


@query(TREE + ", w as (select 120 as node, 0 as depth union select e.dst, depth + 1 from w join edge e on e.src = w.node where depth < 30) select node as oid, min(depth) as depth, node * 2 as value from w group by 1")
def map_graph(spark, sf_dir):
    return graph.map_graph(graph.edges_of(tree_facts(spark, sf_dir), "parent"), oids(spark, 120), lambda n: n * 2)


@query("select 1000000000 + c_nationkey as oid, c_custkey as v from customer")
def inverse_slot(spark, sf_dir):
    rules = infer.Rules().define("customers", infer.inverse("c_nationkey"))
    return rules.values(world_facts(spark, sf_dir), "customers").select("oid", F.col("vo").alias("v"))


@query("select c_custkey as oid, c_mktsegment as v from customer union select c_custkey, c_name from customer")
def multi_slot(spark, sf_dir):
    rules = infer.Rules().define("label", infer.multi("c_mktsegment", "c_name"))
    return rules.values(customer_facts(spark, sf_dir), "label").select("oid", F.col("vs").alias("v"))


@query("with recursive up as (select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey) select 1000000000 + n_nationkey as oid, r_name as v from up union select 2000000000 + r_regionkey, r_name from region")
def inherited_slot(spark, sf_dir):
    facts = world_facts(spark, sf_dir).where("slot in ('n_regionkey', 'r_name', 'n_name')")
    rules = infer.Rules().define("r_name", infer.inherited("r_name", "n_regionkey"))
    return rules.values(facts, "r_name").select("oid", F.col("vs").alias("v"))


@query("select event_id as oid, (props::json->>'k')::double as v from events where props::json->>'k' is not null")
def keyed_slot(spark, sf_dir):
    facts = to_facts(read(spark, sf_dir, "events").select("event_id", "props"), "event_id")
    rules = infer.Rules().define("k", infer.keyed("props", "k"))
    return rules.values(facts, "k").select("oid", F.col("vn").alias("v"))


@query("select d.doc_id, d.lang, l.quality from documents d left join labels l using (doc_id)")
def adjunct(spark, sf_dir):
    return infer.with_adjunct(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "doc_id")


@query("with old as (select p_brand, row_number() over (order by p_brand) - 1 + 100 as oid from (select distinct p_brand from part where p_size < 10)), fresh as (select distinct p_brand from part where p_brand not in (select p_brand from old)) select * from old union all select p_brand, 100 + (select count(*) from old) + row_number() over (order by p_brand) - 1 from fresh")
def registry(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    empty = spark.createDataFrame([], "p_brand string, oid bigint")
    known = infer.register(empty, part.where("p_size < 10").select("p_brand"), ["p_brand"], 100)
    return infer.register(known, part.select("p_brand"), ["p_brand"], 100)


# edits


def _edited(spark, sf_dir):
    base = customer_facts(spark, sf_dir)
    row = lambda rows: spark.createDataFrame(rows, model.FACTS)
    edits = store.Edits(base).add(row([(0, "tag", "str", "a", None, None), (1, "tag", "str", "b", None, None)])).drop(row([(1, "tag", "str", "b", None, None)]))
    edits = edits.drop(base.where("slot = 'c_mktsegment' and vs = 'MACHINERY'"))
    return edits.store(row([(2, "c_mktsegment", "str", "NONE", None, None)])).view()


EDITED = """select c_custkey as oid, 'c_mktsegment' as slot, c_mktsegment as v from customer where c_mktsegment <> 'MACHINERY' and c_custkey <> 2 union all select 2, 'c_mktsegment', 'NONE' union all select 0, 'tag', 'a'"""


@query(EDITED)
def edit_overlay(spark, sf_dir):
    return _edited(spark, sf_dir).where("slot in ('c_mktsegment', 'tag')").select("oid", "slot", F.col("vs").alias("v"))


@query(EDITED)
def commit_snapshot(spark, sf_dir):
    """The edited facts, written as a second version and read back."""
    import uuid

    from lattica.plans.storage import shared_folder

    s = store.Store(spark, f"{shared_folder(spark)}/stores/{uuid.uuid4().hex}")
    s.commit(customer_facts(spark, sf_dir), "base")
    s.commit(_edited(spark, sf_dir), "edited")
    return s.read().where("slot in ('c_mktsegment', 'tag')").select("oid", "slot", F.col("vs").alias("v"))


@query("select c_custkey as oid, 'drop' as change, c_mktsegment as v from customer where c_mktsegment = 'MACHINERY' or c_custkey = 2 union all select 2, 'add', 'NONE' union all select 0, 'add', 'a'")
def snapshot_diff(spark, sf_dir):
    return store.diff(customer_facts(spark, sf_dir), _edited(spark, sf_dir)).select("oid", "change", F.col("vs").alias("v"))


# scalar functions


@query(r"""select c_custkey, upper(c_name) as up, lower(c_mktsegment) as low, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) as cap, not regexp_matches(c_name, '\p{Lu}') as is_low, regexp_matches(c_name, '^\p{Lu}') as is_cap,
 strlen(c_name) as bytes, len(regexp_extract_all(c_name, '\S+')) as n_words, ends_with(c_mktsegment, 'ING') or ends_with(c_mktsegment, 'URE') as suffix, case when ends_with(c_mktsegment, 'ING') then c_mktsegment[:-4] when ends_with(c_mktsegment, 'G') then c_mktsegment[:-2] else c_mktsegment end as stripped,
 replace(replace(c_name, '#', '-'), '0', 'o') as swapped from customer""")
def string_functions(spark, sf_dir):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return read(spark, sf_dir, "customer").select("c_custkey", F.upper(name).alias("up"), F.lower(seg).alias("low"), strings.capitalize(seg).alias("cap"), strings.is_lowercase(name).alias("is_low"), strings.is_capitalized(name).alias("is_cap"), strings.byte_length(name).alias("bytes"), strings.phrase_length(name).alias("n_words"), strings.has_suffix(seg, "ING", "URE").alias("suffix"), strings.strip_suffix(seg, "G", "ING").alias("stripped"), strings.subst(name, "#", "-", "0", "o").alias("swapped"))


@query(r"""select doc_id, len(regexp_extract_all(text, '[^\x09-\x0d\x20]+')) as n_words, round(len(regexp_extract_all(text, '\p{L}')) / length(text), 9) as alpha, length(regexp_replace(text, '<[^>]*>', '', 'g')) as unmarked, length(translate(text, 'aeiouAEIOU', '')) as no_vowels, regexp_extract(text, '^([^\x09-\x0d\x20]*)', 1) as first from documents""")
def text_measures(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", text.count_words(t).alias("n_words"), F.round(text.alpha_share(t), 9).alias("alpha"), F.length(text.strip_markup(t)).alias("unmarked"), F.length(text.disemvowel(t)).alias("no_vowels"), text.first_word(t).alias("first"))


@query(r"""select doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) as std, strip_accents(text) as base from documents""")
def std_strings(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", strings.std_space(F.col("text")).alias("std"), strings.base_string(F.col("text")).alias("base"))


@query("""with s as (select p_partkey, ' ' || lower(p_name) || ' ' as t from part) select p_partkey, array_to_string(list_sort(list_distinct(list_transform(range(1, length(t)), lambda i: t[i:i + 1]))), '|') as two, len(list_distinct(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2]))) as three from s""")
def character_ngrams(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(strings.bigrams(F.col("p_name")), "|").alias("two"), F.size(strings.trigrams(F.col("p_name"))).alias("three"))


@query(r"""with w as (select page_id, list_filter(regexp_split_to_array(regexp_replace(url, '[^a-z]+', ' ', 'g'), '\s+'), lambda x: x <> '') as w from pages) select page_id, array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), '|') as runs from w""")
def word_fragments(spark, sf_dir):
    words = text.segment(F.regexp_replace("url", "[^a-z]+", " "))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(text.fragments(words, 2), "|").alias("runs"))


@query("select c_custkey, md5(c_name) as m, sha256(c_name) as s from customer")
def digests(spark, sf_dir):
    name = F.col("c_name")
    return read(spark, sf_dir, "customer").select("c_custkey", F.lower(F.hex(text.md5(name))).alias("m"), F.lower(F.hex(text.sha2(name, 256))).alias("s"))


@query("""select p_partkey, ((p_size - 25) % 7 + 7) % 7 as floored, ((p_size - 25) % -7 - 7) % -7 as negative, (p_size - 25) % 7 as rest, sign(p_size - 25)::bigint * (abs(p_size - 25) // 7) as quot, round((p_size - 25) / 2.0)::double as rounded, gcd(p_partkey, p_size) as g, lcm(p_partkey + 1, p_size + 1) as l, floor(sqrt(p_partkey))::bigint as root, (p_size % 2 = 1) as odd, lower(printf('%X', p_partkey)) as hex from part""")
def number_functions(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    x = size - 25
    return read(spark, sf_dir, "part").select("p_partkey", numbers.modulo(x, F.lit(7)).alias("floored"), numbers.modulo(x, F.lit(-7)).alias("negative"), numbers.remainder(x, F.lit(7)).alias("rest"), numbers.quotient(x, F.lit(7)).alias("quot"), numbers.round_half_away(x / 2).alias("rounded"), numbers.gcd(key, size).alias("g"), numbers.lcm(key + 1, size + 1).alias("l"), numbers.integer_sqrt(key).alias("root"), numbers.is_odd(size).alias("odd"), numbers.to_hex(key).alias("hex"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as iso, strftime(o_orderdate, '%Y%m%dT%H%M%S') as basic, year(o_orderdate) as y, date_trunc('month', o_orderdate)::date::varchar as m,
 array_to_string(list_sort(list_filter([case when month(o_orderdate) >= 12 or month(o_orderdate) < 4 then 'winter' end, case when month(o_orderdate) between 3 and 5 then 'spring' end, case when month(o_orderdate) between 6 and 9 then 'summer' end, case when month(o_orderdate) between 9 and 11 then 'autumn' end], lambda x: x is not null)), ',') as season,
 '+' || strftime(o_orderdate, '%Y') || ',+' || strftime(o_orderdate, '%Y-%m') || ',+' || strftime(o_orderdate, '%Y-%m-%d') as keys, epoch(o_orderdate - timestamp '1995-01-01')::double as since from orders""")
def time_functions(spark, sf_dir):
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", time.iso(d).alias("iso"), time.iso_basic(d).alias("basic"), F.year(d).alias("y"), time.iso_date(time.truncate(d, "month")).alias("m"), F.array_join(time.season(d), ",").alias("season"), F.array_join(time.iso_keys(d), ",").alias("keys"), time.difference(d, F.lit("1995-01-01").cast("timestamp_ntz")).alias("since"))


@query("""select event_id, hour(ts) as h, array_to_string(list_sort(list_filter([case when hour(ts) < 5 or hour(ts) > 20 then 'nighttime' end, case when hour(ts) between 5 and 11 then 'morning' end, case when hour(ts) between 12 and 18 then 'afternoon' end, case when hour(ts) between 17 and 21 then 'evening' end], lambda x: x is not null)), ',') as part from events""")
def time_of_day(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.hour("ts").alias("h"), F.array_join(time.time_of_day(F.col("ts")), ",").alias("part"))


@query("""with s as (select l_orderkey, list(l_linenumber order by l_linenumber) as a from lineitem group by 1) select l_orderkey, a[1] as head, len(a[2:3]) as mid, len(a[1:len(a) - 1]) as but_last, case when list_position(a, 3) > 0 then list_position(a, 3) - 1 end as third, list_sum(a)::bigint as total, array_to_string(list_reverse(a), ',') as back, len(list_filter(a, lambda x: x % 2 = 0)) as evens from s""")
def sequence_functions(spark, sf_dir):
    a = F.col("a")
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("a"))
    total = sequences.reduce_(a.cast("array<bigint>"), lambda x, acc: acc + x)
    return rows.select("l_orderkey", sequences.elt(a, 0).alias("head"), F.size(sequences.slice_(a, 1, 3)).alias("mid"), F.size(sequences.slice_(a, 0, -1)).alias("but_last"), sequences.position(a, F.lit(3)).alias("third"), total.alias("total"), F.array_join(F.reverse(a).cast("array<string>"), ",").alias("back"), F.size(sequences.remove_if(a, lambda x: x % 2 == 1)).alias("evens"))


@query("""with s as (select l_orderkey, l_returnflag as k, list_sort(list(distinct l_suppkey % 5)) as v from lineitem group by 1, 2) select l_orderkey, string_agg(k, ',' order by k) as keys, sum(len(v))::int as pairs, coalesce(max(array_to_string(v, ',')) filter (k = 'R'), '') as r from s group by 1""")
def map_functions(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    per = line.groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 5)).alias("v"))
    m = F.col("m")
    rows = per.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "v"))).alias("m"))
    return rows.select("l_orderkey", F.array_join(maps.keys(m), ",").alias("keys"), maps.pair_count(m).alias("pairs"), F.array_join(maps.get(m, F.lit("R")).cast("array<string>"), ",").alias("r"))


@query("select event_id, (props::json->>'k')::bigint as k from events")
def json_functions(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", maps.json_parse(F.col("props"), "k bigint")["k"].alias("k"))


@query(r"""select page_id, nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1), '') as scheme, nullif(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '') as host, regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) as path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') as query, nullif(regexp_extract(url, '#(.*)$', 1), '') as frag from pages""")
def uri_functions(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", maps.uri_scheme(u).alias("scheme"), maps.uri_host(u).alias("host"), maps.uri_path(u).alias("path"), maps.uri_query(u).alias("query"), maps.uri_fragment(u).alias("frag"))


# patterns


@query(r"""select doc_id, regexp_matches(text, '\+1 \([0-9]{3}\) 555-[0-9]{4}') as phone, len(regexp_extract_all(text, '[0-9]+(\.[0-9]+){3}')) as addresses, length(regexp_replace(text, '[0-9]+', '#', 'g')) as masked from documents""")
def pattern_search(spark, sf_dir):
    t = F.col("text")
    digits = ("isdigit+",)
    phone = ["+1 (", ("isdigit",), ("isdigit",), ("isdigit",), ") 555-", ("isdigit",), ("isdigit",), ("isdigit",), ("isdigit",)]
    dotted = [digits, ".", digits, ".", digits, ".", digits]
    return read(spark, sf_dir, "documents").select("doc_id", pattern.contains(t, phone).alias("phone"), F.size(pattern.gather_list(t, dotted)).alias("addresses"), F.length(pattern.subst(t, digits, "#")).alias("masked"))


@query(r"""select p_partkey, regexp_extract(p_brand, '^([A-Za-z]+)#([0-9]+)$', 1) as word, regexp_extract(p_brand, '^([A-Za-z]+)#([0-9]+)$', 2) as digits from part where regexp_matches(p_brand, '^([A-Za-z]+)#([0-9]+)$')""")
def pattern_frames(spark, sf_dir):
    frame = pattern.get_frame(F.col("p_brand"), [("bos",), ("label", "word", ("isalpha+",)), "#", ("label", "digits", ("isdigit+",)), ("eos",)])
    return read(spark, sf_dir, "part").withColumn("f", frame).where("f is not null").select("p_partkey", "f.word", "f.digits")


@query(r"""select c_custkey from customer where regexp_matches(c_name, '^Customer#0*[1-4]+$')""")
def pattern_match(spark, sf_dir):
    p = ["Customer#", ("chars*", "0"), ("+", {"1", "2", "3", "4"})]
    return read(spark, sf_dir, "customer").where(pattern.matches(F.col("c_name"), p)).select("c_custkey")


# text analytics without a SQL form


@query()
def phonetic_keys(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(text.get_words(F.col("text"))).alias("word")).distinct()
    return words.select("word", text.soundex(F.col("word")).alias("soundex"), text.metaphone(F.col("word")).alias("metaphone"), text.porter_stem(F.col("word")).alias("stem"))


@query()
def fuzzy_index(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    postings = fuzzy.index_text(docs, "doc_id", "text", ["the", "and", "that"])
    return postings.groupBy("key").agg(F.count("*").alias("docs"))


@query("""with w as (select unnest(regexp_extract_all(lower(p_name), '[a-z]+')) as word from part), forms as (select word, case when ends_with(word, 's') then word[:-2] end as cut from w) select distinct word, case when word in (select lower(p_type) from part) or not ends_with(word, 's') then word when cut in (select word from w where not ends_with(word, 's') union select lower(p_type) from part) then cut end as root from forms""")
def morph_rules(spark, sf_dir):
    words = read(spark, sf_dir, "part").select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z]+)"), F.lit(1))).alias("word"))
    lexicon = words.select(F.col("word").alias("entry")).where("not endswith(entry, 's')")
    known = lexicon.union(read(spark, sf_dir, "part").select(F.lower("p_type")))
    out = text.morph_rules(words.distinct(), "word", [("s", "")], known, "entry")
    return out.select("word", F.when(F.col("root").isNotNull(), F.col("root")).alias("root"))


# points, sources, streams


@query("""with c as (select c_custkey, (c_custkey * 7 % 170) - 85.0 as lat, (c_custkey * 13 % 360) - 180.0 as lon from customer), s as (select s_suppkey, (s_suppkey * 11 % 170) - 85.0 as lat, (s_suppkey * 17 % 360) - 180.0 as lon from supplier),
 d as (select c_custkey, s_suppkey, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2)))) as km from c, s) select c_custkey, s_suppkey, round(km, 3) as km from d where km <= 400""")
def geo_near(spark, sf_dir):
    at = lambda key, a, b: [F.col(key), (F.col(key) * a % 170 - 85.0).alias("lat"), (F.col(key) * b % 360 - 180.0).alias("lon")]
    c = read(spark, sf_dir, "customer").select(*at("c_custkey", 7, 13))
    s = read(spark, sf_dir, "supplier").select(*at("s_suppkey", 11, 17))
    return geo.near(c, s, 400.0, "c_custkey", "s_suppkey").select(F.col("a_key").alias("c_custkey"), F.col("b_key").alias("s_suppkey"), F.round("km", 3).alias("km"))


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    from lattica.plans.storage import shared_folder

    return f"{shared_folder(spark)}/queries/{name}-{uuid.uuid4().hex}"


@query("select p_partkey, p_name from part where p_partkey in (3, 50, 77)")
def pool_round_trip(spark, sf_dir):
    path = _folder(spark, "pool")
    io.write_pool(read(spark, sf_dir, "part"), path, "p_partkey", 1 << 20)
    frames, info = io.open_pool(spark, path)
    return io.fetch(frames, info["key"], [3, 50, 77]).select("p_partkey", "p_name")


@query("select c_custkey as oid from customer where c_mktsegment = 'HOUSEHOLD'")
def index_round_trip(spark, sf_dir):
    path = _folder(spark, "index")
    search.write_index(search.index_frames(customer_facts(spark, sf_dir), "c_mktsegment", "c_name"), path)
    return search.find_frames(spark.read.schema(model.FACTS).parquet(path), ("c_mktsegment", "HOUSEHOLD"))


@query("select n_nationkey + 1000000000 as oid, 'n_name' as slot, n_name as v from nation union all select n_nationkey + 1000000000, 'n_regionkey', (2000000000 + n_regionkey)::varchar from nation")
def object_round_trip(spark, sf_dir):
    path = _folder(spark, "objects")
    io.write_objects(to_facts(read(spark, sf_dir, "nation"), "n_nationkey", oid_slots={"n_regionkey": REGION}, base=NATION), path)
    return io.read_objects(spark, path).select("oid", "slot", model.value_text().alias("v"))


@query("select c_nationkey, count(*) as n from customer where c_acctbal > 100 group by 1")
def sql_procedure(spark, sf_dir):
    read(spark, sf_dir, "customer").createOrReplaceTempView("lattica_customer")
    return io.procedure(spark, "select c_nationkey, count(*) as n from lattica_customer where c_acctbal > :least group by 1")(least=100)


@query("select page_id, len(regexp_extract_all(html, '<li>')) as li, len(regexp_extract_all(html, '<a ')) as a from pages")
def markup_nodes(spark, sf_dir):
    nodes = io.markup_nodes(read(spark, sf_dir, "pages"), "page_id", "html")
    return nodes.groupBy("page_id").agg(F.count_if(F.col("tag") == "li").alias("li"), F.count_if(F.col("tag") == "a").alias("a"))


@query("select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1")
def stream_task(spark, sf_dir):
    """The events as a queue that a task works through in micro-batches, each batch a branch; the branches are merged at the end."""
    path = _folder(spark, "task")
    read(spark, sf_dir, "events").repartition(4).write.parquet(f"{path}/queue")
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    source = engine.items(spark, f"{path}/queue", schema, files_per_batch=2)
    engine.run(source, engine.branch_writer(f"{path}/branches"), "task-" + path[-8:], checkpoint=f"{path}/checkpoint")
    merged = engine.merge_branches(spark, f"{path}/branches")
    return merged.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


from lattica import queries_more  # noqa: E402, F401  (registers its queries here)
