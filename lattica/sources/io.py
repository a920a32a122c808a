"""Sources and sinks: pools and indexes as tables, external SQL, files, object lines, archives, markup."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lattica.plans.model import FACTS


def write_pool(wide: DataFrame, path: str, key: str, capacity: int, base: int = 0, partitions: int | None = None, compression: str = "zstd") -> None:
    """A pool: rows of frames, range-partitioned by id so that id ranges skip files, with its base and capacity beside it."""
    rows = wide.repartitionByRange(partitions, key) if partitions else wide.repartitionByRange(key)
    rows.sortWithinPartitions(key).write.option("compression", compression).parquet(f"{path}/frames")
    spark = wide.sparkSession
    spark.createDataFrame([(key, base, capacity)], "key string, base bigint, capacity bigint").coalesce(1).write.json(f"{path}/pool")


def open_pool(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    info = spark.read.schema("key string, base bigint, capacity bigint").json(f"{path}/pool").first().asDict()
    return spark.read.parquet(f"{path}/frames"), info


def pool_load(frames: DataFrame, key: str) -> DataFrame:
    """How many frames a pool holds, and its first and last ids."""
    return frames.agg(F.count("*").alias("load"), F.min(key).alias("first"), F.max(key).alias("last"))


def fetch(frames: DataFrame, key: str, ids: Sequence[int]) -> DataFrame:
    """Frames by id: a short list reaches the scan as a filter, a long one is joined."""
    if len(ids) <= 1000:
        return frames.where(F.col(key).isin(list(ids)))
    wanted = frames.sparkSession.createDataFrame([(i,) for i in ids], "__id bigint")
    return frames.join(wanted, F.col(key) == F.col("__id"), "left_semi")


def glue(*pools: DataFrame) -> DataFrame:
    """Several pools as one; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pools)


def write_type_index(postings: DataFrame, path: str) -> None:
    """An index of few keys: a folder per value, so that a key's postings are read alone."""
    postings.select("slot", F.coalesce("vs", F.col("vo").cast("string"), F.col("vn").cast("string")).alias("value"), "oid").write.partitionBy("slot", "value").parquet(path)


def append_log(postings: DataFrame, path: str) -> None:
    """An index that is only added to."""
    postings.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACTS).parquet(path).distinct()


def jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """Rows of an external database; `partition` (column, lower, upper, number) splits the read. Needs the database's driver."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").options(**options)
    if partition:
        column, low, high, n = partition
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n)
    return reader.load()


class SQLiteSource(DataSource):
    """Rows of a SQLite file on a path that all executors see. Options: path, query; numPartitions and partitionBy (an integer
    expression) split the read."""

    @classmethod
    def name(cls) -> str:
        return "lattica_sqlite"

    def schema(self) -> str:
        from urllib.parse import quote

        con = sqlite3.connect(f"file:{quote(self.options['path'])}?mode=ro", uri=True)
        try:
            cur = con.execute(f"select * from ({self.options['query']}) limit 200")
            rows = cur.fetchall()
            kinds = {int: "bigint", float: "double", bytes: "binary"}
            out = []
            for i, d in enumerate(cur.description):
                seen = {type(r[i]) for r in rows if r[i] is not None}
                kind = kinds.get(seen.pop(), "string") if len(seen) == 1 else "double" if seen and seen <= {int, float} else "string"
                out.append(f"`{d[0]}` {kind}")
            return ", ".join(out)
        finally:
            con.close()

    def reader(self, schema) -> DataSourceReader:
        return _SQLiteReader(dict(self.options), schema)


class _SQLiteReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.o, self.types = options, [f.dataType.simpleString() for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(int(self.o.get("numpartitions", 1)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        n = int(self.o.get("numpartitions", 1))
        query = self.o["query"] if n == 1 else f"select * from ({self.o['query']}) where abs({self.o['partitionby']}) % {n} = {partition.value}"
        con = sqlite3.connect(f"file:{self.o['path']}?mode=ro", uri=True)
        try:
            for row in con.execute(query):
                yield tuple(str(x) if x is not None and t == "string" else x for x, t in zip(row, self.types))
        finally:
            con.close()


def sqlite(spark: SparkSession, path: str, query: str, partitions: int = 1, by: str = "rowid") -> DataFrame:
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("lattica_sqlite").options(path=path, query=query, numPartitions=partitions, partitionBy=by).load()


def procedure(spark: SparkSession, query: str) -> Callable[..., DataFrame]:
    """A prepared query over the session's tables, with :names for its arguments; its rows are a set."""
    return lambda **args: spark.sql(query, args=args).distinct()


class CallbackSource(DataSource):
    """Rows that functions make: option `module` names one with partitions() and fetch(partition), and `schema` its schema."""

    @classmethod
    def name(cls) -> str:
        return "lattica_callback"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return _CallbackReader(self.options["module"])


class _CallbackReader(DataSourceReader):
    def __init__(self, module: str):
        self.module = module

    def _functions(self):
        import importlib

        return importlib.import_module(self.module)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self._functions().partitions()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self._functions().fetch(partition.value)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole texts with their paths."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    return spark.read.option("lineSep", separator).text(path)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """path, name, content of the members of zip archives: an archive is opened by one task, which holds a member at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pd.DataFrame({"path": [where], "name": [name], "content": [z.read(name)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, content binary")


def write_objects(facts: DataFrame, path: str) -> None:
    """Frames as lines of JSON: the id, and each slot's values with their types."""
    value = F.struct("vtype", "vs", "vn", "vo")
    slots = facts.groupBy("oid", "slot").agg(F.array_sort(F.collect_set(value)).alias("values"))
    slots.groupBy("oid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "values")))).alias("slots")).write.json(path)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """The facts that write_objects() wrote."""
    rows = spark.read.schema("oid bigint, slots map<string, array<struct<vtype:string, vs:string, vn:double, vo:bigint>>>").json(path)
    each = rows.select("oid", F.explode("slots").alias("slot", "values")).select("oid", "slot", F.explode("values").alias("v"))
    return each.select("oid", "slot", "v.vtype", "v.vs", "v.vn", "v.vo")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).format("xml").load(path)


def markup_nodes(pages: DataFrame, key: str, column: str) -> DataFrame:
    """A row per element of HTML texts: key, node (its number in the document), parent, tag, attributes, text (its own)."""
    from html.parser import HTMLParser

    void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def parse(markup: str) -> list[tuple]:
        nodes: list[list] = []
        open_: list[int] = []

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                nodes.append([len(nodes), open_[-1] if open_ else None, tag, {k: v or "" for k, v in attrs}, ""])
                if tag not in void:
                    open_.append(len(nodes) - 1)

            def handle_startendtag(self, tag, attrs):
                nodes.append([len(nodes), open_[-1] if open_ else None, tag, {k: v or "" for k, v in attrs}, ""])

            def handle_endtag(self, tag):
                for i in range(len(open_) - 1, -1, -1):
                    if nodes[open_[i]][2] == tag:
                        del open_[i:]
                        return

            def handle_data(self, data):
                if open_:
                    nodes[open_[-1]][4] += data

        r = Reader(convert_charrefs=True)
        r.feed(markup)
        r.close()
        return nodes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, markup in zip(b["__k"], b["__m"]):
                rows = parse(markup) if isinstance(markup, str) else []
                if rows:
                    out = pd.DataFrame(rows, columns=["node", "parent", "tag", "attributes", "text"])
                    out.insert(0, key, k)
                    out["parent"] = out["parent"].astype("Int64")
                    yield out

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key).alias("__k"), F.col(column).alias("__m")).mapInPandas(run, f"{key} {kind}, node bigint, parent bigint, tag string, attributes map<string,string>, text string")


