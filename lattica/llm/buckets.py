"""Pairs of rows that share a bucket, met in blocks: no bucket is held whole by one task, and no table of pairs is made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import checked_broadcast, materialize

#: Table rows of a bucket that one task holds; a fuller bucket is dealt out in parts of this size.
BUCKET_ROWS = 4096
#: Pairs that are looked at together, and rows (or their bytes) that are read before they are.
PAIRS, ROWS, HELD = 1_000_000, 200_000, 32 << 20


def full_buckets(rows: DataFrame, bucket: Column, total: int, label: str = "full") -> DataFrame:
    """bucket and parts of the buckets with over BUCKET_ROWS rows. Buckets are first counted in cells of some thousand rows, which
    partial aggregation keeps small; only those of cells that hold more are counted one by one."""
    cells = max(1, total // 1024)
    cell = F.pmod(bucket, F.lit(cells).cast("bigint"))
    crowded = materialize(rows.groupBy(cell.alias("crowded")).count().where(F.col("count") > BUCKET_ROWS).select("crowded"), label + "-cells")
    if crowded.isEmpty():
        return crowded.select(F.col("crowded").alias("full"), F.lit(1).alias("parts"))
    inside = rows.select(bucket.alias("full")).withColumn("cell", F.pmod("full", F.lit(cells).cast("bigint"))).join(checked_broadcast(crowded), F.col("cell") == F.col("crowded"), "left_semi")
    counted = inside.groupBy("full").count().where(F.col("count") > BUCKET_ROWS)
    return materialize(counted.select("full", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("parts")), label)


def dealt(rows: DataFrame, columns: list[str], total: int) -> DataFrame:
    """Rows (bucket, probe, columns) with a key instead of a bucket, sorted by (key, probe). A bucket with over BUCKET_ROWS table
    rows (not probe) becomes several keys, each with a share of the table rows and all the probes; the table rows are probes of
    the other parts. Keys that collide only add comparisons. total: how many table rows there are, about."""
    full = full_buckets(rows.where("not probe"), F.col("bucket"), total)
    if full.isEmpty():
        keyed = rows.select(F.col("bucket").alias("key"), "probe", *columns)
    else:
        both = rows.join(checked_broadcast(full), F.col("bucket") == F.col("full"), "left")
        both = both.select(F.coalesce("parts", F.lit(1)).alias("parts"), "bucket", "probe", *columns)
        part = F.pmod(F.xxhash64(*columns), F.col("parts").cast("bigint"))
        own = both.where("not probe").select(F.when(F.col("parts") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", part)).alias("key"), "probe", *columns)
        every = both.where("probe or parts > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        every = every.select(F.when(F.col("parts") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.col("part").cast("bigint"))).alias("key"), F.lit(True).alias("probe"), *columns)
        keyed = own.union(every)
    return keyed.repartition("key").sortWithinPartitions("key", "probe")


def meet(batches: Iterator[list[np.ndarray]], found: Callable[[list[np.ndarray], np.ndarray, np.ndarray], list[np.ndarray]], merge: Callable[..., list[np.ndarray]] | None = None, weigh: Callable[[list[np.ndarray]], int] = lambda rows: 0) -> Iterator[list[np.ndarray]]:
    """Over batches of the columns key, probe and others, sorted as dealt() sorts them: found(columns, x, y) for blocks of pairs of row numbers, where y is a table row that stands
    before x in its bucket. Yields the arrays that found returns, joined (and merged) over ROWS rows, or over HELD bytes as `weigh` has
    them of a batch."""
    held: list[list[np.ndarray]] = []
    weight = 0

    def flush() -> list[np.ndarray]:
        key, probe, *columns = (np.concatenate(x) for x in zip(*held))
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[new, len(key)])
        table = np.add.reduceat((~probe).astype(np.int64), new)
        begin = np.repeat(new, size)
        many = np.minimum(np.arange(len(key)) - begin, np.repeat(table, size))
        sums = np.cumsum(many)
        out, at = [], 0
        while at < len(key):
            end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS, "right")))
            m = many[at:end]
            x = np.repeat(np.arange(at, end), m)
            y = np.repeat(begin[at:end] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            out.append(found(columns, x, y))
            at = end
        joined = [np.concatenate(x) for x in zip(*out)]
        last = (key == key[-1]) & ~probe  # the table rows that later rows of the last bucket still have to meet
        held[:] = [[key[last], probe[last], *(c[last] for c in columns)]]
        return merge(*joined) if merge else joined

    for batch in batches:
        if len(batch[0]):
            held.append(batch)
            weight += weigh(batch)
        if sum(len(r[0]) for r in held) >= ROWS or weight >= HELD:
            yield flush()
            weight = 0
    if sum(len(r[0]) for r in held):
        yield flush()


def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for b in batches:
        yield [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
