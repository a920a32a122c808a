"""More registered queries: regular expressions, tests of values, conditionals, sequences, numbers, texts, times, sources, closures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import math as numbers
from lattica.functions import regexes, sequences, strings, time
from lattica.functions.regexes import Regex
from lattica.operators import graph, infer, search, sets
from lattica.plans import model
from lattica.plans.model import Pool, to_facts
from lattica.queries import TREE, _folder, customer_facts, oids, query, read, tree_facts
from lattica.sources import io

# regular expressions


@query(r"""select page_id, nullif(length(regexp_extract(html, '^((?s:.)*?)<a [^>]*>', 1)), 0) as at, nullif(regexp_extract(html, '<a [^>]*>'), '') as tag,
  case when regexp_matches(html, '<a [^>]*>') then length(regexp_extract(html, '<a [^>]*>')) end as wide, regexp_matches(html, '(?i)<LI>') as li, regexp_full_match(url, 'https?://[^/]*/') as bare,
  case when regexp_matches(url, '^[a-z]+') then length(regexp_extract(url, '^[a-z]+')) end as scheme, len(list_distinct(regexp_extract_all(html, '<[a-z]+'))) as tags from pages""")
def regex_functions(spark, sf_dir):
    h, u, a = F.col("html"), F.col("url"), Regex("<a [^>]*>")
    span = regexes.match_span(a, h)
    return read(spark, sf_dir, "pages").select(
        "page_id", F.nullif(regexes.search(a, h), F.lit(0)).alias("at"), regexes.match_string(a, h).alias("tag"), (span["end"] - span["start"]).alias("wide"), Regex("<LI>", nocase=True)(h).alias("li"),
        regexes.match(Regex("https?://[^/]*/"), u).alias("bare"), regexes.match_length(Regex("[a-z]+"), u).alias("scheme"), F.size(regexes.gather(Regex("<[a-z]+"), h)).alias("tags"),
    )


@query("select c_custkey from customer where regexp_matches(c_name, '[02468]$') and c_mktsegment in ('BUILDING', 'MACHINERY') and c_custkey between 0 and 1023 and c_acctbal % 2 > 1")
def pick_forms(spark, sf_dir):
    """A pattern, a list, a pool and a function with an argument as tests."""
    above = lambda v, n: v % 2 > n
    return search.pick_where(read(spark, sf_dir, "customer"), c_name=Regex("[02468]$"), c_mktsegment=["BUILDING", "MACHINERY"], c_custkey=Pool("first", 0, 1024), c_acctbal=(above, 1)).select("c_custkey")


@query("select c_custkey from customer where not (regexp_matches(c_name, '[02468]$') or c_name = 'Customer#000000007')")
def reject_forms(spark, sf_dir):
    return search.reject_where(read(spark, sf_dir, "customer"), c_name=[Regex("[02468]$"), "Customer#000000007"]).select("c_custkey")


@query("select c_custkey as oid from customer where length(c_mktsegment) = 9")
def testp_function(spark, sf_dir):
    facts = customer_facts(spark, sf_dir)
    return search.testp(facts, facts.select("oid").distinct(), "c_mktsegment", lambda v: F.length(v["vs"]) == 9)


@query("select c_custkey as oid from customer where c_nationkey in (select n_nationkey from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA')")
def testp_table(spark, sf_dir):
    facts = customer_facts(spark, sf_dir)
    asia = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return search.testp(facts, facts.select("oid").distinct(), "c_nationkey", asia.select((F.col("n_nationkey") + 1_000_000_000).alias("vo")))


# conditionals and quantifiers

CONDITIONS = """with c as (select c_custkey, case when c_nationkey % 3 = 0 then null else c_acctbal > 0 end as t, c_mktsegment = 'BUILDING' as u, c_mktsegment as m from customer)"""


@query(CONDITIONS + """ select c_custkey, case when t is null then null when t then 'yes' else 'no' end as if_, coalesce(case when coalesce(t, false) then coalesce(case when u then 'first' end, 'second') end, 'none') as tryif,
  case when coalesce(t, true) then 'a' when u then 'b' else 'c' end as cond, case when m in ('BUILDING', 'MACHINERY') then 1 when m = 'AUTOMOBILE' then 2 else 3 end as kind, case when t then 1 end as when_, case when not t then 1 end as unless_,
  case when t is null then null when not t then false else u end as both_, case when t then true else u end as either, not t as not_ from c""")
def conditionals(spark, sf_dir):
    own = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_acctbal") > 0).alias("t"), (F.col("c_mktsegment") == "BUILDING").alias("u"), F.col("c_mktsegment").alias("m"))
    t, u, one = F.col("t"), F.col("u"), F.lit(1)
    return own.select(
        "c_custkey", sets.if_set(t, F.lit("yes"), F.lit("no")).alias("if_"), F.coalesce(sets.tryif(t, F.when(u, "first"), F.lit("second")), F.lit("none")).alias("tryif"),
        sets.cond((t, F.lit("a")), (u, F.lit("b")), otherwise=F.lit("c")).alias("cond"), sets.case(F.col("m"), (["BUILDING", "MACHINERY"], one), ("AUTOMOBILE", F.lit(2)), otherwise=F.lit(3)).alias("kind"),
        sets.when(t, one).alias("when_"), sets.unless(t, one).alias("unless_"), sets.and_(t, u).alias("both_"), sets.or_(t, u).alias("either"), sets.not_(t).alias("not_"),
    )


@query("""with s as (select c_nationkey, list(substr(c_name, 17)) as names from customer group by 1) select c_nationkey, len(list_filter(names, lambda x: try_cast(x as int) % 2 = 0)) > 0 as some_even, len(list_filter(names, lambda x: try_cast(x as int) % 2 = 1)) = 0 as all_even from s""")
def quantifiers_skip(spark, sf_dir):
    own = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(F.substring("c_name", 17, 10)).alias("names"))
    even = lambda x: x.try_cast("int") % 2 == 0
    return own.select("c_nationkey", sets.some_or_skip(F.col("names"), even).alias("some_even"), sets.every_or_skip(F.col("names"), even).alias("all_even"))


@query("select event_type, count(distinct user_id) as members from events group by 1")
def choice_sizes(spark, sf_dir):
    return sets.choice_size(read(spark, sf_dir, "events"), ["event_type"], "user_id")


@query("select l_orderkey, least(count(distinct l_suppkey), 2) as picked, least(count(distinct l_suppkey), 3) as sampled, true as inside from lineitem group by 1")
def pick_and_sample(spark, sf_dir):
    own = sets.collect(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey", "s")
    sample = sets.sample_n(F.col("s"), 3, seed=7)
    return own.select("l_orderkey", F.size(sets.pick_n(F.col("s"), 2)).cast("bigint").alias("picked"), F.size(sample).cast("bigint").alias("sampled"), (F.size(F.array_except(sample, "s")) == 0).alias("inside"))


# sequences

LINES = "with s as (select l_orderkey, list(l_quantity::int order by l_linenumber, l_quantity::int, l_suppkey) as a, list(l_suppkey::int order by l_linenumber, l_quantity::int, l_suppkey) as b from lineitem group by 1)"


def _lines(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_suppkey").cast("int").alias("s")))).alias("x"))
    return own.select("l_orderkey", F.col("x.q").alias("a"), F.col("x.s").alias("b"))


@query(LINES + """ select l_orderkey, len(a) = 3 as three, len(a) > 1 as more, len(a) <= 2 as few, len(list_filter(a, lambda x: not x > 5)) = 0 as all_big, len(list_filter(a, lambda x: x > 45)) > 0 as some_huge,
  list_filter(a, lambda x: x > 25)[1] as big, list_filter(a, lambda x: not x > 25)[1] as small, len(list_filter(a, lambda x: x > 25)) as n_big, case when list_contains(a, 7) then 7 end as seven,
  array_to_string(list_concat(a, b), ',') as both_, array_to_string(list_prepend(0, a), ',') as consed, len(list_distinct(list_transform(b, lambda x: x % 3))) as kinds, array_to_string(list_sort(list_distinct(a[2:])), ',') as later, array_to_string(list_reverse(a), ',') as back from s""")
def sequence_predicates(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    big = lambda x: x > 25
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return _lines(spark, sf_dir).select(
        "l_orderkey", sequences.length_is(a, "=", 3).alias("three"), sequences.length_is(a, ">", 1).alias("more"), sequences.length_is(a, "<=", 2).alias("few"), sequences.every(a, lambda x: x > 5).alias("all_big"),
        sequences.some(a, lambda x: x > 45).alias("some_huge"), sequences.find_if(a, big).alias("big"), sequences.find_if_not(a, big).alias("small"), F.size(sequences.remove_if_not(a, big)).cast("bigint").alias("n_big"),
        sequences.find(a, F.lit(7)).alias("seven"), text(sequences.append(a, b)).alias("both_"), text(sequences.cons(F.lit(0), a)).alias("consed"), F.size(sequences.map_to_set(lambda x: x % 3, b)).cast("bigint").alias("kinds"),
        text(sequences.elements(a, 1)).alias("later"), text(sequences.reverse(a)).alias("back"),
    )


@query(LINES + """ select l_orderkey, array_to_string(list_sort(a), ',') as up, array_to_string(list_reverse_sort(a), ',') as down, list_position(a, a[len(a)]) - 1 as first_at, array_to_string(list_transform(range(1, len(a) + 1), lambda i: (a[i] * b[i])::int), ',') as products,
  (list_filter(range(0, len(a)), lambda i: a[i + 1] <= 25))[1] as small_at, array_to_string(list_transform(a, lambda x, i: case when i = 1 then 0 else x end), ',') as set_, array_to_string(a[2:], ',') as rest_ from s""")
def sequence_order(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return _lines(spark, sf_dir).select(
        "l_orderkey", text(sequences.sorted_by(a, lambda x: x)).alias("up"), text(sequences.sorted_by(a, lambda x: x, reverse=True)).alias("down"), sequences.position(a, F.get(a, F.size(a) - 1)).alias("first_at"),
        text(sequences.map_(lambda x, y: x * y, a, b)).alias("products"), sequences.position_if_not(a, lambda x: x > 25).cast("bigint").alias("small_at"), text(sequences.set_at(a, 0, F.lit(0))).alias("set_"), text(sequences.rest(a)).alias("rest_"),
    )


@query("select p_partkey, len(string_split(p_name, '')) as characters, array_to_string(list_reverse(string_split(p_brand, '')), '') as back, octet_length(encode(p_brand)) as bytes, ascii(p_brand) as first from part")
def sequence_conversions(spark, sf_dir):
    name, brand = F.col("p_name"), F.col("p_brand")
    packet = sequences.text_to_packet(brand)
    return read(spark, sf_dir, "part").select("p_partkey", F.size(sequences.text_to_vector(name)).cast("bigint").alias("characters"), sequences.vector_to_text(sequences.reverse(sequences.text_to_vector(brand))).alias("back"), F.size(packet).cast("bigint").alias("bytes"), F.get(packet, 0).alias("first"))


# numbers


@query("""select o_orderkey, trunc(o_totalprice / 7)::bigint as cut, ceil(o_totalprice / 7)::bigint as up, floor(-o_totalprice / 7)::bigint as down, gcd(o_orderkey, o_custkey)::bigint as g, lcm(o_orderkey, o_custkey)::bigint as l,
  ((o_custkey % 7) + 7) % 7 as m, -(o_custkey // 7) as q, printf('%.3f', o_totalprice) as said, (o_orderkey % 2 = 1) as odd, floor(sqrt(o_custkey))::bigint as root, lower(printf('%X', o_orderkey)) as hexed from orders""")
def number_more(spark, sf_dir):
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", numbers.to_exact(p / 7).alias("cut"), numbers.to_exact(p / 7, 1).alias("up"), numbers.to_exact(-p / 7, -1).alias("down"), numbers.gcd(k, c).alias("g"), numbers.lcm(k, c).alias("l"), numbers.modulo(c, F.lit(7)).alias("m"),
        numbers.quotient(-c, F.lit(7)).alias("q"), numbers.number_text(p, 3).alias("said"), numbers.is_odd(k).alias("odd"), numbers.integer_sqrt(c).alias("root"), numbers.to_hex(k).alias("hexed"),
    )


WANG = "with a as (select c_custkey, c_custkey::hugeint as x from customer), b as (select c_custkey, xor(xor(x, 61), x >> 16) as y from a), c as (select c_custkey, y + y * 8 as y from b), d as (select c_custkey, xor(y, y >> 4) * 668265261 as y from c)"


@query(WANG + " select c_custkey, xor(y, y >> 15)::bigint as hash32, (c_custkey % 256)::bigint * 16777216 + (c_custkey // 256 % 256) * 65536 + (c_custkey // 65536 % 256) * 256 + c_custkey // 16777216 as flipped, (c_custkey * 2654435761 % 4294967296)::bigint as knuth from d")
def integer_hashes(spark, sf_dir):
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", numbers.wang_hash32(k).alias("hash32"), numbers.flip32(k).alias("flipped"), numbers.knuth_hash(k).alias("knuth"))


# texts


@query(r"""select p_partkey, upper(p_name) as up, lower(p_type) as low, replace(replace(p_name, 'a', 'e'), 'o', 'u') as swapped, regexp_matches(p_name, '^[a-m]') or p_brand = 'Brand#11' as some_, case when p_size > 25 then p_brand || '!' else '' end as big,
  p_name < p_type as before, lower(p_name) = lower(p_type) as same, starts_with(p_name, p_brand) as begins, octet_length(encode(p_name)) as bytes from part""")
def string_more(spark, sf_dir):
    n, t, b = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    return read(spark, sf_dir, "part").select(
        "p_partkey", strings.upcase(n).alias("up"), strings.downcase(t).alias("low"), strings.subst_all(n, "a", "e", "o", "u").alias("swapped"), strings.matches_some(n, Regex("^[a-m]")).__or__(strings.matches_some(b, "Brand#11")).alias("some_"),
        strings.text_if(F.col("p_size") > 25, b, F.lit("!")).alias("big"), strings.compare_chain("<", n, t).alias("before"), strings.compare_chain("=", n, t, ignore_case=True).alias("same"), F.startswith(n, b).alias("begins"),
        F.octet_length(strings.to_packet(n)).cast("bigint").alias("bytes"),
    )


# times


@query("""select event_id, year(ts)::int as y, month(ts)::int as m, dayofweek(ts)::int as d, dayofyear(ts)::int as n, week(ts)::int as w, epoch_us(ts) // 1000000 as tick, epoch_us(ts) // 1000 as milli, lower(strftime(ts, '%b')) as named, lower(strftime(ts, '%a')) as weekday,
  strftime(ts, '%Y-%m-%dT%H:%M') as minute, ts > timestamp '2024-01-01' as later from events""")
def time_parts(spark, sf_dir):
    t = F.col("ts")
    names = {"y": "year", "m": "month", "d": "dayofweek", "n": "dayofyear", "w": "week", "tick": "tick", "milli": "milli", "named": "monthname", "weekday": "weekday"}
    start = F.lit("2024-01-01").cast("timestamp")
    return read(spark, sf_dir, "events").select("event_id", *(time.part(t, p).alias(c) for c, p in names.items()), time.precise(t, "minute").alias("minute"), time.is_later(t, start).alias("later"))


# closures and computed slots


@query(TREE + ", w as (select 37 as root, 37 as node union select 90, 90 union select w.root, e.dst from w join edge e on e.src = w.node) select root, node from w")
def kleene_star(spark, sf_dir):
    return graph.kleene_star(tree_facts(spark, sf_dir), oids(spark, 37, 90), ["parent"])


@query(TREE + ", w as (select src as root, src as node from edge union select w.root, e.dst from w join edge e on e.src = w.node) select root as oid, node as v from w")
def star_slot(spark, sf_dir):
    rules = infer.Rules().define("above", infer.star("parent"))
    return rules.values(tree_facts(spark, sf_dir), "above").select("oid", F.col("vo").alias("v"))


@query(TREE + ", w as (select src as root, src as node from edge union select w.root, e.dst from w join edge e on e.src = w.node) select root as oid, node as v from w where root <> node")
def plus_slot(spark, sf_dir):
    rules = infer.Rules().define("above", infer.plus("parent"))
    return rules.values(tree_facts(spark, sf_dir), "above").select("oid", F.col("vo").alias("v"))


@query("select c_custkey as oid, c_mktsegment as v from customer")
def first_of_pair_slot(spark, sf_dir):
    pairs = read(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.array("c_mktsegment", F.col("c_nationkey").cast("string"))).alias("pair"))
    rules = infer.Rules().define("segment", infer.first_of_pair("pair"))
    return rules.values(to_facts(pairs, "c_custkey"), "segment").select("oid", F.col("vs").alias("v"))


# pools and indexes


@query("select range as oid from range(4096, 6144)")
def pool_scan(spark, sf_dir):
    return model.pool_elements(spark, Pool("p", 4096, 1 << 20), 0, 2048)


@query("select s_suppkey as k, s_name as name, null::varchar as segment from supplier union all select 1000000 + c_custkey, c_name, c_mktsegment from customer")
def glued_pools(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    customers = read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1_000_000).alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return io.glue(suppliers, customers)


@query("select count(*) as load, min(p_partkey) as first, max(p_partkey) as last from part")
def pool_load(spark, sf_dir):
    return io.pool_load(read(spark, sf_dir, "part"), "p_partkey")


@query("select p_brand as v, count(*) as frames from part group by 1")
def log_index(spark, sf_dir):
    """An index that is added to twice, with repeats."""
    path = _folder(spark, "log")
    facts = to_facts(read(spark, sf_dir, "part"), "p_partkey", ["p_brand"])
    io.append_log(facts, path)
    io.append_log(facts.where("oid % 3 = 0"), path)
    return io.read_log(spark, path).groupBy(F.col("vs").alias("v")).agg(F.count("*").alias("frames"))


@query("select c_custkey as oid from customer where c_mktsegment = 'BUILDING'")
def type_index(spark, sf_dir):
    path = _folder(spark, "types")
    io.write_type_index(search.index_frames(customer_facts(spark, sf_dir), "c_mktsegment"), path)
    return spark.read.parquet(path).where("slot = 'c_mktsegment' and value = 'BUILDING'").select("oid")


@query("select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding), 2) as total from orders")
def running_sum(spark, sf_dir):
    out = sets.running(read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_totalprice"), "total")
    return out.select("o_custkey", "o_orderkey", F.round("total", 2).alias("total"))
