"""Navigation and closure over slots that hold ids of frames.

Closures run breadth first. A graph of at most MAX_EDGES edges is broadcast, and each task walks it from its own roots; beyond, a
loop of the driver joins the frontier with the edges and leaves out what was seen, so that cycles end: its rounds are written to the
shared folder, and only counts reach the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.model import Frames, facts_of
from lattica.plans.storage import dropped, written


#: Edges of a graph that is broadcast (16 MB), and cells (roots x nodes) that a task marks at once.
MAX_EDGES, CELLS = 1_000_000, 1 << 24


def edges_of(facts: DataFrame | Frames, *slots: str) -> DataFrame:
    """src, dst of the slots' values that are frames."""
    return facts_of(facts, *slots).where(F.col("vtype") == "oid").select(F.col("oid").alias("src"), F.col("vo").alias("dst")).distinct()


def getpath(facts: DataFrame | Frames, frames: DataFrame, path: Sequence[str]) -> DataFrame:
    """The values at the end of a path of slots from a set of frames (oid): columns start, vtype, vs, vn, vo. One equi-join per step;
    all steps but the last go on from values that are frames."""
    now = frames.select(F.col("oid").alias("start"), F.col("oid").alias("at")).distinct()
    for k, slot in enumerate(path):
        step = facts_of(facts, slot).select(F.col("oid").alias("at"), "vtype", "vs", "vn", "vo")
        joined = now.join(step, "at")
        if k + 1 == len(path):
            return joined.select("start", "vtype", "vs", "vn", "vo").distinct()
        now = joined.where("vtype = 'oid'").select("start", F.col("vo").alias("at")).distinct()
    return now


def _walks(links: DataFrame, start: DataFrame, max_rounds: int) -> DataFrame:
    """closure() over a graph that every task holds: roots are walked from many at a time, level by level."""
    arcs = links.toPandas()  # MAX_EDGES rows at most
    nodes, ends = np.unique(arcs.to_numpy(np.int64).ravel(), return_inverse=True)
    src, dst = ends.reshape(-1, 2).T if len(arcs) else (np.zeros(0, np.int64),) * 2
    order = np.argsort(src, kind="stable")
    graph = links.sparkSession.sparkContext.broadcast((nodes, np.searchsorted(src[order], np.arange(len(nodes) + 1)), dst[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, first, to = graph.value
        n = max(1, len(nodes))
        for b in batches:
            every = b.column("root").to_numpy()
            for s in range(0, len(every), max(1, CELLS // n)):
                roots = every[s : s + max(1, CELLS // n)]
                yield _rows(roots, roots, 0)
                at = np.minimum(np.searchsorted(nodes, roots), n - 1)
                known = np.flatnonzero(nodes[at] == roots) if len(nodes) else np.zeros(0, np.int64)
                seen = np.zeros(len(roots) * n, bool)
                now = known * n + at[known]
                seen[now] = True
                for depth in range(1, max_rounds + 2):
                    node = now % n
                    many = first[node + 1] - first[node]
                    reached = to[np.repeat(first[node] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                    now = np.unique(np.repeat(now - node, many) + reached)
                    now = now[~seen[now]]
                    if not len(now):
                        break
                    if depth > max_rounds:
                        raise RuntimeError(f"the closure is deeper than {max_rounds} steps")
                    seen[now] = True
                    yield _rows(roots[now // n], nodes[now % n], depth)

    return start.mapInArrow(run, "root bigint, node bigint, depth int")


def _rows(root: np.ndarray, node: np.ndarray, depth: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(root), pa.array(node), pa.array(np.full(len(root), depth, np.int32))], ["root", "node", "depth"])


def closure(edges: DataFrame, roots: DataFrame, reflexive: bool = True, max_rounds: int = 1000) -> DataFrame:
    """Pairs (root, node, depth): every node that each root reaches over edges (src, dst), with the fewest steps. Without
    `reflexive`, roots are left out even where they lie on a cycle of their own."""
    links = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    start = roots.select(F.col("oid").alias("root")).where("root is not null").distinct()
    if links.count() <= MAX_EDGES:
        out = _walks(links, start, max_rounds)
        dropped(links)
        return out if reflexive else out.where("depth > 0")
    frontier = written(start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")), "frontier")
    seen = [frontier]
    for depth in range(1, max_rounds + 1):
        reached = frontier.join(links, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, seen).select(F.col("root").alias("r"), F.col("node").alias("n"))
        new = reached.join(known, (F.col("root") == F.col("r")) & (F.col("node") == F.col("n")), "left_anti")
        frontier = written(new.withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            dropped(frontier)
            break
        seen.append(frontier)
        if len(seen) == 16:  # few tables to read, however deep the graph is
            whole = written(reduce(DataFrame.unionByName, seen), "closure")
            seen = [whole]
    else:
        raise RuntimeError(f"the closure is deeper than {max_rounds} steps")
    out = reduce(DataFrame.unionByName, seen)
    return out if reflexive else out.where("depth > 0")


def get_star(facts: DataFrame, roots: DataFrame, slot: str) -> DataFrame:
    """The roots and every value met while walking the slot: ids are walked on, other values are returned as they are. Columns root,
    vtype, vs, vn, vo."""
    walk = closure(edges_of(facts, slot), roots)
    ids = walk.select("root", F.lit("oid").alias("vtype"), F.lit(None).cast("string").alias("vs"), F.lit(None).cast("double").alias("vn"), F.col("node").alias("vo"))
    rest = facts.where((F.col("slot") == slot) & (F.col("vtype") != "oid")).select(F.col("oid").alias("node"), "vtype", "vs", "vn", "vo")
    return ids.union(walk.join(rest, "node").select("root", "vtype", "vs", "vn", "vo")).distinct()


def inherit(facts: DataFrame, frames: DataFrame, slots: Sequence[str], through: Sequence[str]) -> DataFrame:
    """The values of slots at every frame that is reached over `through`, and the start frames themselves."""
    walk = closure(edges_of(facts, *through), frames)
    own = facts.where(F.col("slot").isin(list(slots))).select(F.col("oid").alias("node"), "vtype", "vs", "vn", "vo")
    values = walk.join(own, "node").select("root", "vtype", "vs", "vn", "vo")
    start = frames.select(F.col("oid").alias("root"), F.lit("oid").alias("vtype"), F.lit(None).cast("string").alias("vs"), F.lit(None).cast("double").alias("vn"), F.col("oid").alias("vo"))
    return values.union(start).distinct()


def path_exists(facts: DataFrame, frames: DataFrame, slots: Sequence[str], target: int) -> DataFrame:
    """The frames that reach the target (which reaches itself). The walk goes backwards from the target."""
    turned = edges_of(facts, *slots).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    spark = facts.sparkSession
    back = closure(turned, spark.createDataFrame([(target,)], "oid bigint"))
    return frames.select("oid").join(back.select(F.col("node").alias("oid")), "oid", "left_semi")


def basis(facts: DataFrame, members: DataFrame, lattice: Sequence[str]) -> DataFrame:
    """The members that no other member reaches over the lattice."""
    up = closure(edges_of(facts, *lattice), members, reflexive=False)
    reached = up.where("root <> node").select(F.col("node").alias("oid")).distinct()
    return members.select("oid").distinct().join(reached, "oid", "left_anti")


def map_graph(edges: DataFrame, roots: DataFrame, fn=None) -> DataFrame:
    """Every node that the roots reach together (breadth first, any arcs), and fn of it as `value`."""
    one = roots.select("oid").distinct()
    links = edges.select("src", "dst")
    spark = edges.sparkSession
    # one walk for all roots: an artificial root with an arc to each
    top = one.select(F.lit(-(2**63) + 1).alias("src"), F.col("oid").alias("dst"))
    walk = closure(links.union(top), spark.createDataFrame([(-(2**63) + 1,)], "oid bigint"), reflexive=False)
    nodes = walk.select(F.col("node").alias("oid"), (F.col("depth") - 1).alias("depth"))
    return nodes if fn is None else nodes.withColumn("value", fn(F.col("oid")))


def kleene_star(facts: DataFrame, roots: DataFrame, slots: Sequence[str]) -> DataFrame:
    """Closure over several slots mixed, with the roots."""
    return closure(edges_of(facts, *slots), roots).select("root", "node")


def kleene_plus(facts: DataFrame, roots: DataFrame, slots: Sequence[str]) -> DataFrame:
    """kleene_star() without any of the roots."""
    walk = closure(edges_of(facts, *slots), roots)
    return walk.join(roots.select(F.col("oid").alias("node")), "node", "left_anti").select("root", "node")
