"""Parts that several operators share: word splitting on Arrow buffers, tables in the shared folder, checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Maps A-Z to a-z and every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes that the numpy kernels take at once; a longer text is taken alone, whole.
SLICE_BYTES = 1 << 20
#: Spark's setting of the largest Arrow batch.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where the cluster names none (tests), a temporary one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lattica-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lattica/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns the written table: a short lineage that outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() returned and that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver happens to
    collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_heaps(spark: SparkSession) -> None:
    """Has the executors collect their garbage, whereupon G1 gives the free heap back to the system; else a heap stays as large as it
    ever was, beside the Python workers of what comes next. Two tasks a core reach every executor that is idle; where the JVM has
    explicit collections disabled, nothing happens."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of df has (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _give_back() -> None:
    """Freed memory goes back to the system: Python workers are kept between stages and would else stay as large as they ever were."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), whose workers give freed memory back when a task ends. Where the session has Spark's default of
    64 MB for an Arrow batch, it is set to 8 MB: a batch is held by the executor and by the worker, in several copies."""
    conf = df.sparkSession.conf
    if conf.get(BATCH) in ("67108864b", "64m"):
        conf.set(BATCH, "8m")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(whole, schema)


def checked_broadcast(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows of a few numbers each (some 16 MB), else df as it is,
    which joins by shuffling. df must be cheap to count, such as a materialized table."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (from 0) of a string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column's texts come to at most limit bytes, or to one text."""
    for batch in batches:
        _, off = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


class Words(NamedTuple):
    """The words `[^\\x20\\x09-\\x0D]+` of some texts: their bytes without gaps, n + 1 offsets, each text's first word (texts + 1),
    and where each word starts in the texts."""

    raw: np.ndarray
    off: np.ndarray
    first: np.ndarray
    at: np.ndarray

    def encoded(self) -> tuple[np.ndarray, pa.StringArray]:
        """An id for each word, and the distinct words by id."""
        n = len(self.off) - 1
        if not n:
            return np.zeros(0, np.int64), pa.array([], pa.string())
        words = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(self.off, np.int64)), pa.py_buffer(np.ascontiguousarray(self.raw)))
        found = words.dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def words(raw: np.ndarray, off: np.ndarray) -> Words:
    """Splits texts, given as bytes and offsets; a word never spans two texts."""
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(raw):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    out = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=out[1:])
    return Words(raw[inside], out, np.searchsorted(starts, off), starts)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finalizer of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def majority(h: np.ndarray, first: np.ndarray, weight: np.ndarray | None = None, most: int = 1) -> np.ndarray:
    """For each group first[i]:first[i+1] of hashes, the 64-bit word whose bit is 1 where over half of the hashes have it; empty groups give 0.
    With a weight from 1 to `most` for each hash, it is over half of the group's weight.

    Eight bits are counted at a time in the byte lanes of a 64-bit word, over runs of hashes that weigh at most 255."""
    sizes = np.diff(first)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    longest = 255 // most
    runs = -(-sizes[full] // longest)
    head = np.zeros(len(full), np.int64)
    np.cumsum(runs[:-1], out=head[1:])
    starts = np.repeat(first[full], runs) + longest * (np.arange(runs.sum()) - np.repeat(head, runs))
    whole = sizes[full] if weight is None else np.add.reduceat(weight.astype(np.int64), first[full])
    lanes = np.uint64(0x0101010101010101)
    got = np.zeros(len(full), np.uint64)
    for k in range(8):
        lane_of = (h >> np.uint64(k)) & lanes
        counts = np.add.reduceat(lane_of if weight is None else lane_of * weight, starts)
        total = np.add.reduceat(counts.view(np.uint8).reshape(-1, 8).astype(np.int64), head, axis=0)
        over = 2 * total > whole[:, None]
        for lane in range(8):
            got |= over[:, lane].astype(np.uint64) << np.uint64(8 * lane + k)
    out[full] = got
    return out


class Joined(NamedTuple):
    """Like Words, but a single space follows each word that isn't its text's last, so that any run of words is one slice."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def joined_words(raw: np.ndarray, off: np.ndarray) -> Joined:
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, off)
    inner = np.ones(len(starts), dtype=bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    keep = inside.copy()
    keep[ends[inner]] = True
    size = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size + inner, out=at[1:])
    spaced = np.where(inside, raw, np.uint8(0x20))[keep]
    return Joined(spaced, at[:-1], at[:-1] + size, first)


#: The byte table of normalized().
PLAIN = LOWER.copy()
PLAIN[[b for b in range(128) if not (48 <= b < 58 or 97 <= LOWER[b] < 123)]] = 0x20


def normalized(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in lower-case A-Z, each run of ASCII signs and white space a single space, none at the ends. Bytes and offsets."""
    out = PLAIN[raw]
    space = out == 0x20
    before = np.ones(len(raw), bool)
    before[1:] = space[:-1]
    edge = off[:-1][off[:-1] < len(raw)]
    before[edge] = True
    keep = ~space | ~before
    at = np.r_[0, np.cumsum(keep)][off].astype(np.int64)
    out = out[keep]
    # a space that is left at a text's end goes too
    last = at[1:][at[1:] > at[:-1]] - 1
    gone = last[out[last] == 0x20]
    if len(gone):
        out = np.delete(out, gone)
        at -= np.searchsorted(gone, at, "left")
    return out, at
