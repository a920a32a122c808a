"""Near copies by the Jaccard similarity of their sets of shingles: SimHash fingerprints and multi-index hashing find most of them, and
prefix filtering finds those whose fingerprints are too far apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.buckets import arrays, dealt, meet
from lattica.llm.common import arrow_map, checked_broadcast, drop_shuffles, majority, materialize, release, sliced, unused
from lattica.llm.components import spanning_edges
from lattica.llm.settle import settle
from lattica.llm.simhash import links, shingles, with_classes

#: Shingles are put in order by how many of some SAMPLE texts have them, where MIN_COUNT or more do, for MAX_COMMON of them at most.
#: Any order gives the same pairs; this one keeps passages that many texts have out of the prefixes of these.
SAMPLE, MIN_COUNT, MAX_COMMON = 20_000, 4, 100_000
EPSILON = 1e-9
#: Words of 64 bits of the longest bitmap of a set, and pairs whose bitmaps are compared together.
BITMAP_WORDS, COMPARED = 64, 10_000


def _sets(texts: pa.Array, shingle: int, common: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of shingle hashes of some texts, joined, each in order of (times, hash), where each begins, and a hash of each set.
    common (sorted) and times: the shingles that are put last."""
    return _sets_of(*shingles(texts, shingle, 42), common, times)


def _sets_of(hashes: np.ndarray, first: np.ndarray, common: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(first) - 1
    hashes = hashes.view(np.int64)
    owner = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    begin = np.searchsorted(owner, np.arange(n + 1))
    whole = hashes.tobytes()
    names = np.array([xxhash.xxh64_intdigest(whole[8 * s : 8 * e], 7) for s, e in zip(begin[:-1].tolist(), begin[1:].tolist())], np.uint64).view(np.int64)
    if len(common) and len(hashes):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, times[at], 0)
        if rank.any():
            hashes = hashes[np.lexsort((hashes, rank, owner))]
    return hashes, begin, names


def bitmaps(hashes: np.ndarray, begin: np.ndarray) -> pa.BinaryArray:
    """The bitmap of each set: bit h mod K is 1 if an odd number of its hashes h have it, where K is a power of two from the size of
    the set on (64 at least, 64 * BITMAP_WORDS at most). Of two sets, as many elements are in one alone as their bitmaps differ in bits, or
    more; in bitmaps of sets that share little, some half of the bits differ."""
    size = np.diff(begin)
    bits = np.int64(1) << np.clip(np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), 6, BITMAP_WORDS.bit_length() + 5)
    off = np.r_[0, np.cumsum(bits)]
    odd = np.bincount(np.repeat(off[:-1], size) + (hashes & np.repeat(bits - 1, size)), minlength=off[-1]) & 1
    data = np.packbits(odd.astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((off // 8).astype(np.int32)), pa.py_buffer(data)])


def differing(bits: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps (bytes) of the pairs x, y differ; the longer one is folded to the length of the other."""
    out = np.empty(len(x), np.int64)
    for s in range(0, len(x), COMPARED):
        rows, at = np.unique(np.r_[x[s : s + COMPARED], y[s : s + COMPARED]], return_inverse=True)
        own = bits[rows]
        words = np.array([len(b) // 8 for b in own], np.int64)
        table = np.frombuffer(b"".join(b.ljust(8 * int(words.max()), b"\0") for b in own), np.uint64).reshape(len(own), -1)
        p, q = at[: len(at) // 2], at[len(at) // 2 :]
        least, got = np.minimum(words[p], words[q]), np.empty(len(p), np.int64)
        for w in np.unique(least).tolist():
            pairs = np.flatnonzero(least == w)
            folded = np.bitwise_xor.reduce((table[p[pairs]] ^ table[q[pairs]]).reshape(len(pairs), -1, w), axis=1)
            got[pairs] = np.bitwise_count(folded).sum(axis=1)
        out[s : s + COMPARED] = got
    return out


def with_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, node (a hash of the set of shingles), n (how many), fp (their SimHash, with repeats) and bitmap of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for b in sliced(batches, "text"):
            hashes, first = shingles(b.column("text"), shingle, 42)
            own, begin, names = _sets_of(hashes, first, none, none)
            columns = [b.column("doc_id"), pa.array(names), pa.array(np.diff(begin).astype(np.int32)), pa.array(majority(hashes, first).view(np.int64)), bitmaps(own, begin)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "fp", "bits"])

    return docs.transform(arrow_map, run, "doc_id bigint, node bigint, n int, fp bigint, bits binary")


def _elements(docs: DataFrame, reps: DataFrame, shingle: int, common: np.ndarray, times: np.ndarray, min_similarity: float | None) -> DataFrame:
    """token, id, n and place of the shingles of the sets in reps (columns id, least): all, or with a similarity those of the
    prefix. Two sets that are alike have the first shingle that they share in both prefixes."""
    wanted = reps.select(F.col("id").alias("wanted"), "least")
    rows = docs.join(checked_broadcast(wanted), F.col("doc_id") == F.col("least")).select("wanted", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            hashes, begin, names = _sets(b.column("text"), shingle, common, times)
            size = np.diff(begin)
            # rows that share a doc_id may have other texts
            many = size if min_similarity is None else np.where(size > 0, size - np.ceil(min_similarity * size - EPSILON).astype(np.int64) + 1, 0)
            many = np.where(names == b.column("wanted").to_numpy(zero_copy_only=False), np.minimum(many, size), 0)
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(begin[:-1], many) + place
            yield pa.RecordBatch.from_arrays([pa.array(hashes[at]), pa.array(np.repeat(names, many)), pa.array(np.repeat(size, many).astype(np.int32)), pa.array(place.astype(np.int32))], ["token", "id", "n", "place"])

    return rows.transform(arrow_map, run, "token bigint, id bigint, n int, place int")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column, those whose value another row has too."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        key = b.column(0).to_numpy()
        new = np.r_[True, key[1:] != key[:-1]]
        open_ = int(np.flatnonzero(new)[-1])  # the last value may go on in the next batch
        alone = new & np.r_[new[1:], True]
        held = b.slice(open_)
        yield b.slice(0, open_).filter(pa.array(~alone[:open_]))
    if held is not None and held.num_rows > 1:
        yield held


def _common(docs: DataFrame, reps: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    part = max(1, reps.count() // SAMPLE)
    some = reps.where(F.pmod("id", F.lit(part).cast("bigint")) == 0)
    counts = _elements(docs, some, shingle, none, none, None).groupBy("token").count().where(F.col("count") >= MIN_COUNT)
    got = counts.orderBy(F.desc("count"), "token").limit(MAX_COMMON).toPandas()
    order = np.argsort(got["token"].to_numpy(np.int64))
    return got["token"].to_numpy(np.int64)[order], got["count"].to_numpy(np.int64)[order]


def _links(shared: DataFrame, nodes: DataFrame, min_similarity: float, forest: bool) -> DataFrame:
    """Links (a, b) between sets of different labels (nodes: id, label) that share a shingle of their prefixes and that sizes,
    places and bitmaps let be alike: a forest of them, or all."""
    columns = ["id", "n", "place", "label", "bits"]
    rows = shared.join(checked_broadcast(nodes.select(F.col("id").alias("own"), "label")), F.col("id") == F.col("own")).drop("own")
    rows = rows.select(F.col("token").alias("bucket"), F.lit(False).alias("probe"), *columns)

    def found(columns: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        ident, n, place = columns[:3]
        n, left = n.astype(np.int64), n.astype(np.int64) - place
        hit = np.minimum(left[x], left[y]) >= min_similarity / (1 + min_similarity) * (n[x] + n[y]) - EPSILON
        hit &= np.minimum(n[x], n[y]) >= min_similarity * np.maximum(n[x], n[y]) - EPSILON
        hit &= columns[3][x] != columns[3][y]
        x, y = x[hit], y[hit]
        # alike sets have at most this part of their elements alone
        hit = differing(columns[4], x, y) <= (1 - min_similarity) / (1 + min_similarity) * (n[x] + n[y]) + EPSILON
        a, b = ident[x[hit]], ident[y[hit]]
        if forest:
            return list(spanning_edges(a, b))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        return [pairs[0], pairs[1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in meet(arrays(batches), found, spanning_edges if forest else None, weigh=lambda rows: sum(map(len, rows[-1]))):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt(rows, columns, shared.count()).transform(arrow_map, run, "a bigint, b bigint")


def _members(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """id and the set of shingle hashes (array of bigint) of the sets in wanted (columns id, least)."""
    rows = docs.join(checked_broadcast(wanted), F.col("doc_id") == F.col("least")).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for b in sliced(batches, "text"):
            hashes, begin, names = _sets(b.column("text"), shingle, none, none)
            out = pa.RecordBatch.from_arrays([pa.array(names), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(hashes))], ["id", "shingles"])
            yield out.filter(pa.array(names == b.column("id").to_numpy(zero_copy_only=False)))

    return rows.transform(arrow_map, run, "id bigint, shingles array<bigint>").dropDuplicates(["id"])


def _near_fingerprints(reps: DataFrame, max_distance: int) -> DataFrame:
    """A forest (a, b) of the links between sets whose fingerprints differ in at most max_distance bits, by multi-index hashing: each
    set is linked with the first one of its fingerprint, and these with each other."""
    heads = materialize(reps.groupBy("fp").agg(F.min("id").alias("head")), "heads")
    near = links(heads, max_distance, "tree")
    near = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    own = reps.select("id", F.col("fp").alias("of")).join(heads, F.col("of") == F.col("fp"))
    return near.select(F.col("x").alias("a"), F.col("y").alias("b")).union(own.select(F.col("id").alias("a"), F.col("head").alias("b")))


def drop_similar(docs: DataFrame, max_distance: int = 7, shingle: int = 5, min_similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are near copies of one with a lesser doc_id; all columns stay. Near copies are linked: their sets
    of shingles have a Jaccard similarity of at least min_similarity. Sets whose fingerprints differ in at most max_distance bits are
    found by multi-index hashing; prefix filtering then finds all links that are left between what these connect, and bitmaps drop most
    pairs that only share a passage before any sets are joined. Each different set is one node, so that copies make no pairs. Rows without doc_id stay and link nothing, rows that repeat a doc_id count as one document."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = materialize(with_sets(own, shingle), "sets")
    reps = materialize(sets.groupBy(F.col("node").alias("id")).agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.count("*").alias("copies"), F.first("bits").alias("bits")), "reps")
    known = reps.where("least is not null and n > 0").select("id", "least", "n", "fp")
    common, times = _common(own, known, shingle)
    prefixes = _elements(own, known, shingle, common, times, min_similarity)
    drop_shuffles(docs.sparkSession)
    met = materialize(prefixes.repartition("token").sortWithinPartitions("token").transform(arrow_map, _shared, prefixes.schema), "met")
    drop_shuffles(docs.sparkSession)
    shared = materialize(met.join(reps.select("id", "bits"), "id").select(*prefixes.columns, "bits"), "shared")

    def search(nodes: DataFrame, forest: bool) -> DataFrame:
        return _links(shared, nodes, min_similarity, forest)

    def verify(found: DataFrame, named: DataFrame) -> DataFrame:
        wanted = materialize(known.join(named, "id", "left_semi").select("id", "least"), "wanted")
        members = _members(own, wanted, shingle)
        both = found.join(members.select(F.col("id").alias("a"), F.col("shingles").alias("s")), "a").join(members.select(F.col("id").alias("b"), F.col("shingles").alias("t")), "b")
        both_have = F.size(F.array_intersect("s", "t"))
        return both.select("a", "b", (both_have >= min_similarity * (F.size("s") + F.size("t") - both_have) - EPSILON).alias("ok"))

    parts = materialize(settle(known.select("id"), search, verify, _near_fingerprints(known, max_distance)), "components")
    least = parts.join(reps, F.col("node") == F.col("id")).groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "top")
    linked = parts.join(least, F.col("root") == F.col("top")).select(F.col("node").alias("key"), "component_id")
    classes = reps.join(linked, F.col("id") == F.col("key"), "left").select(F.col("id").alias("key"), "copies", F.coalesce("component_id", "least").alias("component_id"))
    found = with_classes(sets.select("doc_id", "node"), materialize(classes, "classes"), "node").where("component_id < doc_id")
    name = unused(docs, "gone")
    gone = materialize(found.select(F.col("doc_id").alias(name)).distinct(), "gone")
    for done in (sets, reps, met, shared, parts):
        release(done)
    return docs.join(checked_broadcast(gone), F.col(id_col).cast("bigint") == F.col(name), "left_anti")
