"""Near-duplicate documents by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.buckets import arrays, dealt, meet
from lattica.llm.common import LOWER, arrow_map, buffers, checked_broadcast, joined_words, majority, materialize, sliced
from lattica.llm.components import connected_components, local_forest, spanning_edges


#: Copies from which a class is joined apart.
HOT = 256


def shingles(texts: pa.Array, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, joined, and where each text's begin: lower-case A-Z, words `[^\\x20\\x09-\\x0D]+`, runs of
    `shingle` words with repeats, joined by spaces (fewer words: all of them), XXH64 of each."""
    raw, off = buffers(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    t = joined_words(LOWER[raw], off)
    n = np.diff(t.first)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    begin = np.repeat(t.first[:-1] - first[:-1], count) + np.arange(first[-1])
    last = np.minimum(begin + shingle, np.repeat(t.first[1:], count)) - 1
    text, one = t.raw.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((one(text[s:e], seed) for s, e in zip(t.start[begin].tolist(), t.end[last].tolist())), np.uint64, len(begin)), first


def fingerprints(texts: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """Signed 64-bit SimHash of each text: a bit is 1 if set in over half of the hashes of its shingles. Null and wordless texts give 0."""
    return majority(*shingles(texts, shingle, seed)).view(np.int64)


def with_fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (bigint) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(b.column("text"), shingle, seed))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(arrow_map, run, "doc_id bigint, fp bigint")


def segments(max_distance: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each fingerprint segment. The radii plus one add up to max_distance + 1 at least: of two
    fingerprints within that distance, one segment differs in no more bits than its radius, so that no link is missed."""
    m = max(3, -(-(max_distance + 1) // 2))
    wide = max(0, max_distance + 1 - m)
    cut = [0] + [20 * i for i in range(1, m)] + [64] if m == 3 else [64 * i // m for i in range(m + 1)]
    return [(cut[i], cut[i + 1] - cut[i], int(i < wide)) for i in range(m)]


def _probes(fps: DataFrame, max_distance: int) -> DataFrame:
    """Rows (bucket, fp, probe) for each fingerprint: its own key in each segment's table and, in a segment of radius 1, the keys
    in which one 0 bit of its own is 1. Of two keys that differ in one bit, just one is met from the other so."""
    parts = segments(max_distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            value = fp.view(np.uint64)
            keys, owner, probe = [], [], []
            for k, (shift, bits, radius) in enumerate(parts):
                own = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
                for flip in [0, *(1 << i for i in range(bits * radius))]:
                    at = np.flatnonzero((own & np.uint64(flip)) == 0)
                    keys.append((own[at] | np.uint64(flip)).astype(np.int64) | (k << 56))
                    owner.append(fp[at])
                    probe.append(np.full(len(at), flip != 0))
            rows = [np.concatenate(x) for x in (keys, owner, probe)]
            for i in range(0, len(rows[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in rows], ["bucket", "fp", "probe"])

    return fps.select("fp").transform(arrow_map, run, "bucket bigint, fp bigint, probe boolean")


def _near(columns: list[np.ndarray], x: np.ndarray, y: np.ndarray, max_distance: int) -> np.ndarray:
    return np.bitwise_count((columns[0][x] ^ columns[0][y]).view(np.uint64)) <= max_distance


def links(fps: DataFrame, max_distance: int, how: str = "star") -> DataFrame:
    """Links (a, b) between fingerprints (column fp, each once) of at most max_distance bits, as tasks find them: a forest that links
    each fingerprint with the least one it reaches (star) or along links found (tree), or all of them between fingerprints of
    different `label` (all)."""
    columns = ["fp", "label"] if how == "all" else ["fp"]
    rows = _probes(fps, max_distance)
    if how == "all":
        rows = rows.join(fps.select(F.col("fp").alias("own"), "label"), F.col("fp") == F.col("own")).drop("own")
    merge = {"star": local_forest, "tree": spanning_edges, "all": None}[how]

    def found(columns: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        hit = _near(columns, x, y, max_distance)
        if how == "all":
            hit &= columns[1][x] != columns[1][y]
        a, b = columns[0][x[hit]], columns[0][y[hit]]
        return list(merge(a, b)) if merge else [np.minimum(a, b), np.maximum(a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in meet(arrays(batches), found, merge):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt(rows, columns, fps.count() * len(segments(max_distance))).transform(arrow_map, run, "a bigint, b bigint")


def _classes(reps: DataFrame, parts: DataFrame) -> DataFrame:
    """The columns of the representatives (fp, least and others) with component_id instead of least, from the components (node, root)
    of those that have links."""
    parts = materialize(parts, "components")
    least = parts.join(reps, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("component_id"))
    linked = parts.join(least.withColumnRenamed("root", "top"), F.col("root") == F.col("top")).select("node", "component_id")
    return reps.join(linked, F.col("fp") == F.col("node"), "left").select(*(c for c in reps.columns if c != "least"), F.coalesce("component_id", "least").alias("component_id"))


def _copied_classes(fps: DataFrame, max_distance: int) -> DataFrame:
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "reps")
    return _classes(reps, connected_components(links(reps, max_distance)))


def fingerprint_classes(fps: DataFrame, max_distance: int = 4) -> DataFrame:
    """Columns fp, component_id: for each fingerprint of fps (columns doc_id, fp) the least doc_id that it reaches over links of
    at most max_distance differing bits. Equal fingerprints are one node, so that copies make no pairs."""
    return _copied_classes(fps, max_distance).select("fp", "component_id")


def with_classes(rows: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """rows joined with classes (key, copies and others) by column = key. The classes of many copies, 100,000 of them at most, are
    broadcast, so that no task of the join that shuffles gets more than a small share of the rows for one key."""
    many = max(HOT, classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] // 100_000)
    hot = F.broadcast(classes.where(F.col("copies") > many))
    rest = rows.join(hot.select("key"), F.col(column) == F.col("key"), "left_anti").join(classes.where(F.col("copies") <= many), F.col(column) == F.col("key"))
    return rows.join(hot, F.col(column) == F.col("key")).union(rest)


def near_duplicates(docs: DataFrame, max_distance: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of docs.

    fingerprint is 16 hex digits, component_id the least doc_id that can be reached over links of at most max_distance bits.
    Null, empty and wordless texts have fingerprint zero and are linked with each other; a row without doc_id is kept and has the
    component of its fingerprint, null if no row of the component has an id. Repeated rows are returned as often as they come.
    Other columns are ignored; an empty table gives an empty result."""
    fps = materialize(with_fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    classes = materialize(_copied_classes(fps, max_distance).withColumnRenamed("fp", "key"), "classes")
    return with_classes(fps, classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
