"""Groups over links that are dear to verify: few checks where all are alike, and all that matter where some are not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import checked_broadcast, drop_shuffles, materialize
from lattica.llm.components import connected_components


def settle(nodes: DataFrame, search: Callable[[DataFrame, bool], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame], likely: DataFrame) -> DataFrame:
    """node, root for the nodes (column id, and what search needs) that verified links connect with others.

    likely: links (a, b) that are verified first. search(nodes, forest) gives candidate links between nodes of a different `label`:
    with forest True a forest of them, else all. verify(links, ids) gives the links with `ok`; ids (column id) are the nodes that
    they name.

    What the likely links connect is labelled alike, and a forest of the candidates between labels is verified, which settles groups
    whose members are all alike with as many checks as members. Where a check fails, the candidates between what is not yet
    connected are all verified, so that no link is lost."""
    likely = materialize(likely.where("a <> b").distinct(), "likely")
    known = materialize(verify(likely, likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()).where("ok").select("a", "b"), "known")
    labels = materialize(connected_components(known).select(F.col("node").alias("n"), F.col("root").alias("label")), "labels")
    drop_shuffles(nodes.sparkSession)
    labelled = nodes.join(checked_broadcast(labels), F.col("id") == F.col("n"), "left").drop("n").withColumn("label", F.coalesce("label", "id"))
    found = materialize(search(labelled, True).distinct(), "candidates")
    rough = materialize(connected_components(found.union(known)), "rough")
    checked = materialize(verify(found, found.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "checked")
    drop_shuffles(nodes.sparkSession)
    good = checked.where("ok").select("a", "b").union(known)
    failed = checked.where("not ok").select(F.explode(F.array("a", "b")).alias("bad")).join(rough, F.col("bad") == F.col("node")).select(F.col("root").alias("open_root")).distinct()
    failed = materialize(failed, "open")
    if failed.isEmpty():
        return connected_components(good)
    now = connected_components(good).select(F.col("node").alias("n"), F.col("root").alias("label"))
    still = rough.join(failed, F.col("root") == F.col("open_root"), "left_semi").select("node")
    again = nodes.join(still, F.col("id") == F.col("node"), "left_semi").join(now, F.col("id") == F.col("n"), "left").drop("n")
    again = materialize(again.withColumn("label", F.coalesce("label", "id")), "again")
    more = materialize(search(again, False).distinct(), "more")
    named = more.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    more = materialize(verify(more, named).where("ok").select("a", "b"), "checked")
    return connected_components(good.union(more))
