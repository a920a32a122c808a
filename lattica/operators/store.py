"""Edits that are kept apart from a base table until they are committed, and commits as snapshots."""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans.model import FACTS
from lattica.plans.storage import file_system

ROW = ["oid", "slot", "vtype", "vs", "vn", "vo"]


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(Column.__and__, (a[c].eqNullSafe(b[c]) for c in columns))


def _less(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    b = b.select(*columns)
    return a.join(b, _same(a, b, columns), "left_anti")


class Edits:
    """Adds, drops and stores over a base of facts. An add takes back a drop of the same fact and the other way about; a store replaces
    a slot's values and forgets what was added to and dropped from it."""

    def __init__(self, base: DataFrame, adds: DataFrame | None = None, drops: DataFrame | None = None, stores: DataFrame | None = None, stored: DataFrame | None = None):
        empty = base.sparkSession.createDataFrame([], FACTS)
        self.base, self.adds, self.drops, self.stores = base.select(*ROW), adds or empty, drops or empty, stores or empty
        self.stored = stored if stored is not None else empty.select("oid", "slot")  # (oid, slot) that stores replace

    def add(self, rows: DataFrame) -> Edits:
        rows = rows.select(*ROW)
        return Edits(self.base, self.adds.union(rows).distinct(), _less(self.drops, rows, ROW), self.stores, self.stored)

    def drop(self, rows: DataFrame) -> Edits:
        rows = rows.select(*ROW)
        return Edits(self.base, _less(self.adds, rows, ROW), self.drops.union(rows).distinct(), self.stores, self.stored)

    def store(self, rows: DataFrame, slots: DataFrame | None = None) -> Edits:
        """rows are the new values of their slots; `slots` (oid, slot) may name more, which are left empty."""
        rows = rows.select(*ROW)
        key = ["oid", "slot"]
        replaced = rows.select(*key).union(slots.select(*key) if slots is not None else rows.select(*key)).distinct()
        stores = _less(self.stores, replaced, key).union(rows).distinct()
        return Edits(self.base, _less(self.adds, replaced, key), _less(self.drops, replaced, key), stores, self.stored.union(replaced).distinct())

    def view(self) -> DataFrame:
        """The facts with all edits: (base less stored slots, stores, adds) less drops."""
        kept = _less(self.base, self.stored, ["oid", "slot"])
        return _less(kept.union(self.stores).union(self.adds).distinct(), self.drops, ROW)

    def counts(self) -> dict[str, int]:
        return {"adds": self.adds.count(), "drops": self.drops.count(), "stores": self.stores.count()}


class Store:
    """A folder of snapshots. Each commit writes a new one whole, and then a pointer to it under the next number: readers see the
    old one or the new one. The pointer is written under another name and renamed, which fails if another writer has taken the
    number."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        fs, p = file_system(self.spark, f"{self.path}/log")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())

    def commit(self, facts: DataFrame, note: str = "") -> int:
        version = (self.versions() or [-1])[-1] + 1
        name = f"snapshot-{version}-{time.time_ns()}"
        facts.select(*ROW).repartition("slot", F.pmod(F.xxhash64("oid"), F.lit(16))).sortWithinPartitions("slot", "oid").write.partitionBy("slot").parquet(f"{self.path}/{name}")
        fs, draft = file_system(self.spark, f"{self.path}/log/.draft-{time.time_ns()}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"snapshot": name, "note": note}).encode()))
        out.close()
        _, final = file_system(self.spark, f"{self.path}/log/{version}")
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    def _snapshot(self, version: int) -> str:
        row = self.spark.read.text(f"{self.path}/log/{version}").first()
        return json.loads(row["value"])["snapshot"]

    def read(self, version: int | None = None) -> DataFrame:
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], FACTS)
        schema = "oid bigint, vtype string, vs string, vn double, vo bigint, slot string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self._snapshot(have[-1] if version is None else version)}").select(*ROW)

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the last `keep` snapshots."""
        for v in self.versions()[: -keep or None]:
            for p in (f"{self.path}/{self._snapshot(v)}", f"{self.path}/log/{v}"):
                fs, q = file_system(self.spark, p)
                fs.delete(q, True)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """The facts that were added and dropped: a row each, with `change`."""
    added = _less(new.select(*ROW), old, ROW).withColumn("change", F.lit("add"))
    return added.union(_less(old.select(*ROW), new, ROW).withColumn("change", F.lit("drop")))
