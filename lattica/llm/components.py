"""Connected components of a graph given as a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, materialize, release

#: Edges that one task may hold.
ONE_TASK = 1_000_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b). Each node's least neighbour is found by a partial aggregate, and the join that hands it
    back is a plain equi-join, so that a node of many edges is pre-aggregated in one and split by AQE in the other."""
    turned = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        turned = turned.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = turned.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    joined = turned.join(least, F.col("u") == F.col("w"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Nodes of edges (columns a and b, bigint) with the least node that they reach: columns node, root.

    Self-loops, repeated edges and edges in either direction are allowed; edges with a null end are ignored; without edges the
    result is empty. Up to ONE_TASK edges (16 MB) are settled by one task of an executor, which saves the rounds. Beyond, each round
    is written to the shared folder, so that a lost executor costs one round at most, and the table before it is deleted; a graph
    of diameter d takes some log d rounds."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= ONE_TASK:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
            if got:
                nodes, roots = local_forest(*(np.concatenate(x) for x in zip(*got)))
                top = np.unique(roots)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[nodes, top]), pa.array(np.r_[roots, top])], ["node", "root"])

        return now.coalesce(1).transform(arrow_map, run, "node bigint, root bigint")
    mark = None
    for _ in range(max_rounds):
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == mark or not n:
            break
        mark = (n, total)
        after = materialize(_stars(_stars(now, True), False), "edges")
        release(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def local_forest(a, b):
    """Edges (two arrays of the same length) as a forest with the same components: each node but the least one, linked to the least."""
    if not len(a):
        return a, b
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        if (px == py).all():
            break
        low, high = np.minimum(px, py), np.maximum(px, py)
        np.minimum.at(parent, high, low)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def spanning_edges(a, b):
    """Some of the given edges that make a forest with the same components."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    parent, picked = np.arange(len(nodes)), []
    while len(x):
        px, py = parent[x], parent[y]
        open_ = np.flatnonzero(px != py)
        if not len(open_):
            break
        low, high = np.minimum(px[open_], py[open_]), np.maximum(px[open_], py[open_])
        best = parent.copy()
        np.minimum.at(best, high, low)
        used = best[high] == low
        _, first = np.unique(high[used], return_index=True)
        picked.append(open_[used][first])
        parent = best
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    if not picked:
        return a[:0], b[:0]
    at = np.concatenate(picked)
    return a[at], b[at]
