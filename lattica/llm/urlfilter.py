"""URL filters: a blocked Bloom filter of listed canonical URLs and rules, then an exact hash join of what passes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the filter for each key, and 512-bit blocks that it has at most (64 MB, the bound of what is broadcast). A list that
#: needs more fills the blocks further: more false hits reach the hash join, and the result stays exact.
BITS_PER_KEY, MAX_BLOCKS = 16, 1 << 20


def host(url: Column) -> Column:
    """What stands between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty if url is null or has no `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty if url is null or has no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """The form in which URLs are listed: no scheme, query, fragment, leading `www.` or trailing `/`."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and the bit that it sets in each of the block's eight words."""
    h = F.xxhash64(key)
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("int"), [F.shiftright(h, 6 * i).bitwiseAND(63).cast("int") for i in range(8)]


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of the strings in column `key`, as a table of its blocks that aren't empty: block and words w0 to w7."""
    block, bits = _bits(F.col("key"), blocks)
    rows = keys.select(block.alias("block"), *(F.call_function("shiftleft", F.lit(1).cast("bigint"), b).alias(f"m{i}") for i, b in enumerate(bits)))
    return rows.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(8)))


def maybe_in(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose `key` passes the filter, which is broadcast (MAX_BLOCKS rows at most)."""
    block, bits = _bits(F.col("key"), blocks)
    found = rows.withColumn("__block", block).join(F.broadcast(bloom), F.col("__block") == F.col("block"))
    for i, b in enumerate(bits):
        found = found.where(F.call_function("shiftright", F.col(f"w{i}"), b).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return found.select(*rows.columns)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row (page_id, host, path, rule, verdict, is_listed) per row of pages.

    listed: column `canonical`, the blocked URLs in the form of canonical(). rules: (action, host/path); a rule fits its host and
    all subdomains if the url's path starts with the rule's, and the longest one that fits decides (of equally long ones the first
    in alphabetical order; of one that is given twice, block). Where none fits, a listed url is blocked and any other allowed.

    Null urls and urls without `://` have empty host and path, which no rule fits and no list holds. Repeated rows are returned as
    often as they come; other columns are ignored; an empty list or no rules leave the other half to decide."""
    spark = pages.sparkSession
    of_rule = dict(sorted(((text, action) for action, text in rules), key=lambda x: (x[0], x[1] == "block")))
    entries = spark.createDataFrame([(f"rule {t}", t, a) for t, a in of_rule.items()], "key string, rule string, action string")
    urls = listed.where("canonical <> ''").select(F.concat(F.lit("url "), F.col("canonical")).alias("key")).distinct()
    entries = materialize(entries.union(urls.select("key", F.lit(None).cast("string"), F.lit("block"))), "listed")
    blocks = min(MAX_BLOCKS, max(1, -(-entries.count() * BITS_PER_KEY // 512)))
    bloom = blocked_bloom(entries, blocks)

    # a rule can only equal a run of its own number of host labels with a path prefix of its own length
    shapes = sorted({(t.split("/", 1)[0].count(".") + 1, len(t) - t.index("/")) for t in of_rule})
    keys = [F.when(F.length("path") >= n, F.concat(F.lit("rule "), F.substring_index("host", ".", -labels), F.substring("path", 1, n))) for labels, n in shapes]
    keys.append(F.when(F.concat("host", "path") != "", F.concat(F.lit("url "), canonical(F.col("host"), F.col("path")))))
    own = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    each = own.select("host", "path").distinct().select("host", "path", F.explode(F.array_compact(F.array(*keys))).alias("key"))
    hits = maybe_in(each, bloom, blocks).join(entries.hint("shuffle_hash"), "key")
    best = F.min(F.when(F.col("rule").isNotNull(), F.struct((-F.length("rule")).alias("n"), "rule", "action"))).alias("best")
    verdicts = hits.groupBy("host", "path").agg(best, F.max(F.col("rule").isNull()).alias("is_listed"))
    joined = own.join(verdicts, ["host", "path"], "left")
    is_listed = F.coalesce("is_listed", F.lit(False))
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.when(is_listed, "block").otherwise("allow")).alias("verdict"), is_listed.alias("is_listed"))
