"""Line dedup: SimHash of normalized lines, pigeonhole blocks, edit similarity, and one occurrence for each connected group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lattica.llm.buckets import PAIRS, arrays, dealt, meet
from lattica.llm.common import arrow_map, buffers, checked_broadcast, drop_shuffles, materialize, mix, normalized, release, sliced, unused, words
from lattica.llm.components import connected_components, spanning_edges

#: Bits of a fingerprint. Of the first COMPARED bits of two lines that are compared, MAX_DISTANCE differ at most.
BITS, COMPARED, MAX_DISTANCE, MIN_SIMILARITY = 256, 96, 20, 0.8
#: A fingerprint is looked up by TABLES blocks of BLOCK bits. The bits are dealt out to the blocks in two orders (every STRIDES-th
#: bit). The 14 blocks of an order don't overlap: lines that differ in 13 of its 252 bits or fewer share a block.
TABLES, BLOCK, STRIDES = 20, 18, (1, 37)
COLUMNS = [[STRIDES[t // 14] * (BLOCK * (t % 14) + i) % BITS for i in range(BLOCK)] for t in range(TABLES)]
#: What is kept of a line: its fingerprint, and LENGTH_STEPS times the logarithm of its characters (511 at most).
SKETCH = np.dtype([("fp", "<u8", BITS // 64), ("length", "<u2")])
LENGTH_STEPS = 40
#: Lines of fewer words are made of runs of 3 bytes instead; words of more bytes than LONG count as their runs of 5 bytes.
FEW, LONG = 8, 24
#: Weight of a word by its length in bytes: 1 up to 3, then 2.
WEIGHT = np.array([1 + (n > 3) for n in range(LONG + 1)], np.uint64)
#: Words that are summed up in bytes before these have no more room.
RUN = 255 // 2
#: Entries of a part, which one task holds, and lines whose entries are dealt out to the parts together.
PART, CHUNK = 500_000, 50_000
#: Entries of one block of bits beyond which it is dealt out in shares (also if 16 times as many as on the mean).
FULL = 4096
#: Text that is split into lines at once.
LINE_BYTES = 1 << 19
#: Tables that are looked up in a pass, and lines up to which there is one pass over all. The entries of a pass are gone before the next.
PASS_TABLES, ONE_PASS = 5, 100_000
#: Different lines with copies, or rows with lines that are wanted, up to which these are broadcast (some 32 MB).
MAX_COPIED = 500_000
#: Bits of the filter that tells which lines' texts are wanted: 2 MB, whatever the input.
FILTER_BITS = 24


def split_lines(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The `\\n`-split lines of some texts that have more than signs and spaces, normalized: text number, line number, bytes, offsets."""
    cut = np.flatnonzero(raw == 0x0A)
    begin = np.sort(np.r_[off[:-1], cut + 1], kind="stable")
    owner = np.searchsorted(np.sort(off[:-1]), begin, "right") - 1
    # of the lines that start where an empty text or the next text does, the first ones are empty
    bound = np.r_[begin, len(raw)]
    data, at = normalized(raw, bound)
    kind = np.diff(at) > 0
    number = np.arange(len(begin)) - np.searchsorted(owner, owner, "left")
    return owner[kind], number[kind], data, np.r_[at[:-1][kind], at[-1]]


def hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 128-bit hash of each line, as two signed integers."""
    text, where, one = data.tobytes(), at.tolist(), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([one(text[s:e]) for s, e in zip(where[:-1], where[1:])]), "<i8").reshape(-1, 2)


def _grams(data: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` bytes of data[begin:end] (all bytes where there are fewer), and how many each has."""
    count = np.maximum(end - begin - size + 1, 1)
    place = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
    eight = np.ndarray((len(data),), "<u8", buffer=np.r_[data, np.zeros(8, np.uint8)].tobytes(), strides=(1,))
    left = np.minimum(np.repeat(end, count) - place, size).astype(np.uint64)
    value = eight[place] & ((np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
    return mix(value ^ (left << np.uint64(56)) ^ np.uint64(0x9E3779B97F4A7C15)), count


def fingerprints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """SimHash of each line, an array of lines x 4 words of 64 bits: over its words, weighted by their length, or its runs of bytes."""
    n = len(off) - 1
    if not len(data):
        return np.zeros((n, BITS // 64), np.uint64)
    w = words(data, off)
    ids, vocab = w.encoded()
    many = np.diff(w.first)
    line, size = np.repeat(np.arange(n), many), np.diff(w.off)
    whole = many >= FEW
    as_word = whole[line] & (size <= LONG)
    as_grams = np.flatnonzero(whole[line] & (size > LONG))
    short = np.flatnonzero(~whole & (many > 0))
    g, g_count = _grams(data, w.at[as_grams], w.at[as_grams] + size[as_grams], 5)
    s, s_count = _grams(data, off[short], off[short + 1], 3)
    grams, gram_ids = np.unique(np.r_[g, s], return_inverse=True)
    known, letters = _word_hashes(*buffers(vocab))
    weight = np.r_[WEIGHT[np.minimum(letters, LONG)], np.ones(len(grams), np.uint64)]
    lanes = _lanes(np.r_[known, grams], weight)
    wide = len(weight)
    # what a line says again doesn't count: most lines of a language repeat the same few words
    key = np.concatenate([line[as_word] * wide + ids[as_word], np.repeat(line[as_grams], g_count) * wide + len(known) + gram_ids[: len(g)], np.repeat(short, s_count) * wide + len(known) + gram_ids[len(g) :]])
    key = np.sort(key)
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    owner, part = key // wide, key % wide
    first = np.searchsorted(owner, np.arange(n + 1))
    out = np.zeros((n, BITS // 64), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    runs = -(-np.diff(first)[full] // RUN)
    head = np.cumsum(runs) - runs
    starts = np.repeat(first[full], runs) + RUN * (np.arange(runs.sum()) - np.repeat(head, runs))
    sums = np.empty((len(starts), lanes.shape[1]), np.uint64)
    for s in range(0, len(starts), 4096):  # so that what is looked up at once stays in the cache
        e = min(s + 4096, len(starts))
        at, stop = starts[s], starts[e] if e < len(starts) else len(part)
        sums[s:e] = np.add.reduceat(lanes[part[at:stop]], starts[s:e] - at, axis=0)
    total = np.add.reduceat(sums.view(np.uint8).reshape(len(starts), -1).astype(np.int32), head, axis=0)
    over = 2 * total > np.add.reduceat(weight[part].astype(np.int64), first[full])[:, None]
    out[full] = np.packbits(over.reshape(len(full), -1, 8, 8).transpose(0, 1, 3, 2).reshape(len(full), -1), axis=1, bitorder="little").view(np.uint64)
    return out


def _word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words by their first LONG bytes and their length, and the lengths."""
    size, end = np.diff(off), off[1:]
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=np.r_[data, np.zeros(9, np.uint8)].tobytes(), strides=(1,))
    h = size.astype(np.uint64)
    for k in range(0, LONG, 8):
        left = np.clip(size - k, 0, 8).astype(np.uint64)
        mask = np.where(left < 8, (np.uint64(1) << (left % np.uint64(8) * np.uint64(8))) - np.uint64(1), ~np.uint64(0))
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ (eight[np.minimum(off[:-1] + k, end)] & mask))
    return h, size


def _lanes(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The bits of each hash's fingerprint, times its weight, as bytes: words of eight bytes, of which the k-th of each 64 bits has
    the bits k, 8 + k, 16 + k and so on."""
    out = np.empty((len(h), BITS // 8), np.uint64)
    for k in range(BITS // 64):
        own = mix(h + np.uint64((k + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        for i in range(8):
            out[:, 8 * k + i] = (own >> np.uint64(i) & np.uint64(0x0101010101010101)) * weight
    return out


def sketches(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros(len(off) - 1, SKETCH)
    out["fp"] = fingerprints(data, off)
    characters = np.diff(np.r_[0, np.cumsum((data & 0xC0) != 0x80)][off])
    out["length"] = np.minimum(LENGTH_STEPS * np.log(np.maximum(characters, 1)), 511).astype(np.uint16)
    return out


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and row_key, which tells rows apart that share a doc_id but not the text."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).alias("row_key"), F.col(text_col).cast("string").alias("text"))


def line_table(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, line, h1 and h2 (128-bit hash of the normalized line), sketch of each line that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", LINE_BYTES):
            owner, number, data, at = split_lines(*buffers(b.column("text")))
            h, rows, of = hashes(data, at), sketches(data, at), pa.array(owner)
            packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, rows.nbytes + 1, SKETCH.itemsize, dtype=np.int32)), pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("row_key").take(of), b.column("doc_id").take(of), pa.array(number.astype(np.int32)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), packed], ["row_key", "doc_id", "line", "h1", "h2", "sketch"])

    return docs.transform(arrow_map, run, "row_key bigint, doc_id bigint, line int, h1 bigint, h2 bigint, sketch binary")


def block_keys(fp: np.ndarray, tables: range = range(TABLES)) -> np.ndarray:
    """The key of each fingerprint (lines x 4 words) in each of the tables: lines x tables, the number of the table before BLOCK bits."""
    words = np.ascontiguousarray(fp).view(">u8").astype(np.uint64).T.copy()  # the first bit is the highest
    out = np.empty((len(fp), len(tables)), np.uint32)
    mask, top = np.uint64((1 << BLOCK) - 1), 64 - BLOCK
    for i, t in enumerate(tables):
        columns = COLUMNS[t]
        if columns[-1] - columns[0] == BLOCK - 1:  # a run of bits, in one word or two
            w, begin = divmod(columns[0], 64)
            if begin <= top:
                key = words[w] >> np.uint64(top - begin) & mask
            else:
                key = (words[w] << np.uint64(begin - top) | words[w + 1] >> np.uint64(64 + top - begin)) & mask
        else:
            key = np.zeros(len(fp), np.uint64)
            for c in columns:
                key = key << np.uint64(1) | words[c // 64] >> np.uint64(63 - c % 64) & np.uint64(1)
        out[:, i] = key | np.uint64(t << BLOCK)
    return out


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """id, sketch and label (None without such a column) of CHUNK lines at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield _ids_and_sketches(held)
            held = []
    if sum(x.num_rows for x in held):
        yield _ids_and_sketches(held)


def _ids_and_sketches(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    t = pa.Table.from_batches(held).combine_chunks()
    column = t.column("sketch").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    data, _ = buffers(column.cast(pa.large_binary()).view(pa.large_string()))
    return t.column("id").to_numpy(), np.frombuffer(data.tobytes(), SKETCH), t.column("label").to_numpy() if "label" in t.column_names else None


def full_keys(reps: DataFrame, n: int) -> np.ndarray:
    """The keys (sorted) with more entries than the mean of a key's by far. Each chunk of lines names the keys that it has often: a key
    is missed only if it has less than its share of twice the bound in every chunk. There are some TABLES * 2 ** BLOCK / 16 at most."""
    full = max(FULL, 16 * n >> BLOCK)
    often = max(2, full // (n // CHUNK + reps.rdd.getNumPartitions() + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, line, _ in _unpacked(batches):
            count = np.bincount(block_keys(line["fp"]).ravel(), minlength=1)
            some = np.flatnonzero(count >= often)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["key", "n"])

    got = reps.select("id", "sketch").transform(arrow_map, run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > full)
    return np.sort(got.select("key").toPandas()["key"].to_numpy(np.uint32))


def _pairs(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs of places that have the same key; key is sorted."""
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    begin = np.repeat(new, np.diff(np.r_[new, len(key)]))
    many = np.arange(len(key)) - begin
    sums, at = np.cumsum(many), 0
    while at < len(key):
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS // 4, "right")))
        m = many[at:end]
        yield np.repeat(np.arange(at, end), m), np.repeat(begin[at:end] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        at = end


def _far(min_similarity: float) -> int:
    """By how much the lengths of alike lines, as sketches have them, differ at most."""
    return int(LENGTH_STEPS * -np.log(max(min_similarity, 1e-3)) + 1e-6) + 1


def candidates(reps: DataFrame, max_distance: int = MAX_DISTANCE, min_similarity: float = MIN_SIMILARITY, labelled: bool = False) -> DataFrame:
    """A forest (a, b) of the links between distinct lines (columns id, sketch) that share a block, differ in max_distance of their
    first COMPARED bits at most, and have lengths that let them be alike. If `labelled`, the lines that are so linked with one of
    another `label`, as both a and b.

    The entries (key, id, bits, label) of PASS_TABLES at a time go to parts by key, packed: a row holds what a chunk of lines has for
    a part. Entries of keys that are full are rows of their own, and dealt out in shares."""
    n = reps.count()
    reps = reps.select("id", "sketch", *(["label"] if labelled else []))
    full, far = full_keys(reps, n), _far(min_similarity)
    entry = np.dtype([("key", "<u4"), ("id", "<i8"), ("fp", "<u8"), ("more", "<u4"), *([("label", "<i8")] if labelled else [])])

    def hits(ident: np.ndarray, fp: np.ndarray, more: np.ndarray, length: np.ndarray, label: np.ndarray | None, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        far_bits = np.bitwise_count(fp[x] ^ fp[y])
        some = np.flatnonzero(far_bits <= max_distance)
        x, y = x[some], y[some]
        hit = (far_bits[some] + np.bitwise_count(more[x] ^ more[y]) <= max_distance) & (np.abs(length[x] - length[y]) <= far)
        if label is None:
            return list(spanning_edges(ident[x[hit]], ident[y[hit]]))
        hit &= label[x] != label[y]
        linked = np.unique(np.r_[ident[x[hit]], ident[y[hit]]])
        return [linked, linked]

    def entries(tables: range) -> DataFrame:
        parts = max(1, n * len(tables) // PART)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ident, sketch, label in _unpacked(batches):
                key = block_keys(sketch["fp"], tables).ravel()
                line = np.repeat(np.arange(len(sketch)), len(tables))
                if len(full):
                    at = np.flatnonzero(full[np.minimum(np.searchsorted(full, key), len(full) - 1)] != key)
                    key, line = key[at], line[at]
                part = (mix(key) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                rows = np.empty(len(order), entry)
                line = line[order]
                rows["key"], rows["id"], rows["fp"] = key[order] << np.uint32(9) | sketch["length"][line], ident[line], sketch["fp"][line, 0]
                rows["more"] = sketch["fp"][line, 1].astype(np.uint32)
                if labelled:
                    rows["label"] = label[line]
                names, first = np.unique(part[order], return_index=True)
                cut = np.r_[first, len(order)]
                for s in range(0, len(names), 1000):
                    e = min(s + 1000, len(names))
                    off = ((cut[s : e + 1] - cut[s]) * entry.itemsize).astype(np.int32)
                    packed = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer(off), pa.py_buffer(rows[cut[s] : cut[e]].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(names[s:e]), packed], ["part", "entries"])

        return reps.transform(arrow_map, pack, "part bigint, entries binary")

    def compare(rows: np.ndarray) -> list[np.ndarray]:
        rows = rows[np.argsort(rows["key"], kind="stable")]
        columns = [rows["id"].copy(), rows["fp"].copy(), rows["more"].copy(), (rows["key"] & np.uint32(511)).astype(np.int16), rows["label"].copy() if labelled else None]
        out = [hits(*columns, x, y) for x, y in _pairs(rows["key"] >> np.uint32(9))]
        return [np.concatenate(c) for c in zip(*out)] if out else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for part, data in zip(b.column("part").to_pylist(), b.column("entries")):
                if part != now and held:
                    yield _edges(*compare(np.concatenate(held)))
                    held = []
                now = part
                held.append(np.frombuffer(data.as_buffer(), entry))
        if held:
            yield _edges(*compare(np.concatenate(held)))

    def links(tables: range) -> DataFrame:
        return entries(tables).repartition("part").sortWithinPartitions("part").transform(arrow_map, run, "a bigint, b bigint")

    if n <= ONE_PASS:
        found = links(range(TABLES))
    else:
        passes = []
        for t in range(0, TABLES, PASS_TABLES):
            passes.append(materialize(links(range(t, min(t + PASS_TABLES, TABLES))), "links"))
            drop_shuffles(reps.sparkSession)
        found = reduce(DataFrame.union, passes)
    if not len(full):
        return found

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ident, sketch, label in _unpacked(batches):
            key, fp = block_keys(sketch["fp"]), sketch["fp"]
            label = ident if label is None else label
            line, t = np.nonzero(full[np.minimum(np.searchsorted(full, key), len(full) - 1)] == key)
            for s in range(0, len(line), 100_000):
                own, k = line[s : s + 100_000], key[line[s : s + 100_000], t[s : s + 100_000]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.zeros(len(k), bool)), pa.array(ident[own]), pa.array(fp[own, 0].copy().view(np.int64)), pa.array(fp[own, 1].astype(np.uint32).view(np.int32)), pa.array(sketch["length"][own].astype(np.int16)), pa.array(label[own])], ["bucket", "probe", *columns])

    def near(columns: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        return hits(columns[0], columns[1].view(np.uint64), columns[2].view(np.uint32), columns[3], columns[4] if labelled else None, x, y)

    def crowd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in meet(arrays(batches), near, None if labelled else spanning_edges):
            yield _edges(a, b)

    columns = ["id", "first", "more", "length", "label"]
    rows = materialize(reps.transform(arrow_map, spread, "bucket bigint, probe boolean, id bigint, first bigint, more int, length smallint, label bigint"), "crowded")
    return found.union(dealt(rows, columns, rows.count()).transform(arrow_map, crowd, "a bigint, b bigint"))


def _edges(a=(), b=()) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def edit_distance(s: str, t: str, most: int) -> int:
    """The edit distance of s and t, or some number over `most` if it is greater: bit-parallel, without what both begin or end with."""
    if abs(len(s) - len(t)) > most:
        return most + 1
    if len(s) > len(t):
        s, t = t, s
    n = _common(s, t)
    s, t = s[n:], t[n:]
    n = _common(s[::-1], t[::-1])
    s, t = s[: len(s) - n], t[: len(t) - n]
    if not s:
        return len(t)
    where: dict[str, int] = {}
    for i, c in enumerate(s):
        where[c] = where.get(c, 0) | 1 << i
    full, top, score = (1 << len(s)) - 1, 1 << len(s) - 1, len(s)
    up, down = full, 0
    for left, c in zip(range(len(t) - 1, -1, -1), t):
        same = where.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(across | up) & full, up & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        if score - left > most:
            return most + 1
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        same |= down
        up, down = fall | ~(same | rise) & full, rise & same
    return score


def _common(s: str, t: str) -> int:
    """How many characters s and t begin with alike, by halving."""
    low, high = 0, min(len(s), len(t))
    if s[:high] == t[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if s[low:mid] == t[low:mid] else (low, mid - 1)
    return low


def _at_most(s: str, t: str, most: int) -> int:
    """A bound of the edit distance from above: what s and t begin and end with alike is free, and a run of 12 characters from the
    middle of one that is found in the other near by cuts both in two."""
    n = _common(s, t)
    s, t = s[n:], t[n:]
    n = _common(s[::-1], t[::-1])
    s, t = s[: len(s) - n], t[: len(t) - n]
    longer = max(len(s), len(t))
    if min(len(s), len(t)) > 16:
        for at in (len(s) // 2 - 6, len(s) // 4, 3 * len(s) // 4 - 12):
            at = max(at, 0)
            found = t.find(s[at : at + 12], max(0, at - most), at + most + 12)
            if found >= 0:
                left = _at_most(s[:at], t[:found], most)
                return left if left > most else left + _at_most(s[at:], t[found:], most - left)
    return longer


def alike(s: str, t: str, min_similarity: float) -> bool:
    """Whether the edit distance of two lines is at most 1 - min_similarity of the longer one's length."""
    most = int((1 - min_similarity) * max(len(s), len(t)) + 1e-9)
    if abs(len(s) - len(t)) > most:
        return False
    return _at_most(s, t, most) <= most or edit_distance(s, t, most) <= most


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, h2 and normalized text (line_text) of the distinct lines in wanted (columns id, and row_key of a row that has the line), from
    a second look at the documents: those that are named, where these are few enough to be broadcast, or else all. A filter of fixed
    size passes the lines, and few others that a join then drops."""
    named = wanted.select("row_key").distinct()
    if named.count() <= MAX_COPIED:
        docs = docs.join(F.broadcast(named), "row_key", "left_semi")
    wanted = wanted.select("id")
    size = np.uint64((1 << FILTER_BITS) - 1)
    slot = F.col("id").bitwiseAND(F.lit(int(size)))
    cells = wanted.groupBy(F.shiftright(slot, 5).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(id & 31 as int))")).alias("bits")).toPandas()  # 2 ** 19 rows at most
    marks = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    marks[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", LINE_BYTES):
            _, _, data, at = split_lines(*buffers(b.column("text")))
            h = hashes(data, at)
            spot = (h[:, 0].view(np.uint64) & size).astype(np.int64) if len(h) else np.zeros(0, np.int64)
            hit = np.flatnonzero(marks[spot >> 5] >> (spot & 31).astype(np.uint32) & 1)
            _, once = np.unique(h[hit], axis=0, return_index=True)
            hit = hit[once]
            text = [data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") for i in hit.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(h[hit, 0]), pa.array(h[hit, 1]), pa.array(text, pa.string())], ["key", "h2", "line_text"])

    lines = docs.select("text").transform(arrow_map, run, "key bigint, h2 bigint, line_text string")
    return lines.join(checked_broadcast(wanted), F.col("key") == F.col("id"), "left_semi").groupBy(F.col("key").alias("id")).agg(F.min(F.struct("h2", "line_text")).alias("line")).select("id", "line.h2", "line.line_text")


def _verified(links: DataFrame, texts: DataFrame, min_similarity: float) -> DataFrame:
    """links with `ok`: whether the two lines are alike."""
    left = texts.select(F.col("id").alias("a"), F.col("line_text").alias("s"))
    right = texts.select(F.col("id").alias("b"), F.col("line_text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "s"):
            ok = [alike(s, t, min_similarity) for s, t in zip(b.column("s").to_pylist(), b.column("t").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return links.join(left, "a").join(right, "b").select("a", "b", "s", "t").transform(arrow_map, run, "a bigint, b bigint, ok boolean")


def _rest(nodes: DataFrame, texts: DataFrame, max_distance: int, min_similarity: float) -> DataFrame:
    """A forest of the verified links between lines (columns id, sketch, label) of different labels. First the lines that have such
    candidates are found; then their texts go along, so that a task compares and verifies by itself: no pairs are written, and two
    lines that it has found connected aren't compared."""
    linked = materialize(candidates(nodes, max_distance, min_similarity, labelled=True).select(F.col("a").alias("id")).distinct(), "linked")
    nodes = materialize(nodes.join(checked_broadcast(linked), "id", "left_semi").join(texts.select("id", "line_text"), "id"), "again")
    far = _far(min_similarity)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketch = _ids_and_sketches([b])[1]
            fp, length = sketch["fp"], pa.array(sketch["length"].astype(np.int16))
            key, more = block_keys(fp).astype(np.int64), pa.array(fp[:, 1].astype(np.uint32).view(np.int32))
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(key[:, t]), pa.array(np.zeros(len(fp), bool)), b.column("id"), pa.array(fp[:, 0].copy().view(np.int64)), more, length, b.column("label"), b.column("line_text")], ["bucket", "probe", *columns])

    def found(columns: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        ident, first, more, length, label, text = columns
        hit = np.bitwise_count((first[x] ^ first[y]).view(np.uint64)) + np.bitwise_count((more[x] ^ more[y]).view(np.uint32)) <= max_distance
        hit &= (label[x] != label[y]) & (np.abs(length[x] - length[y]) <= far)
        x, y = x[hit], y[hit]
        up: dict[int, int] = {}

        def root(k: int) -> int:
            while (to := up.get(k, k)) != k:
                up[k] = up.get(to, to)
                k = to
            return k

        a, b = [], []
        for i, j in zip(x.tolist(), y.tolist()):
            p, q = root(int(label[i])), root(int(label[j]))
            if p != q and alike(text[i], text[j], min_similarity):
                up[max(p, q)] = min(p, q)
                a.append(ident[i])
                b.append(ident[j])
        return [np.array(a, np.int64), np.array(b, np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in meet(arrays(batches), found, spanning_edges, weigh=lambda rows: sum(map(len, rows[-1]))):
            yield _edges(a, b)

    columns = ["id", "first", "more", "length", "label", "line_text"]
    rows = nodes.select("id", "sketch", "label", "line_text").transform(arrow_map, spread, "bucket bigint, probe boolean, id bigint, first bigint, more int, length smallint, label bigint, line_text string")
    return dealt(rows, columns, nodes.count() * TABLES).transform(arrow_map, run, "a bigint, b bigint")


def groups(reps: DataFrame, docs: DataFrame, max_distance: int = MAX_DISTANCE, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """node, h2, root for the distinct lines that are linked with others: they share a block, differ in max_distance of COMPARED bits at
    most, and are alike by min_similarity.

    First a forest of the candidates is verified, which settles groups whose members are all alike with as many checks as members.
    Where a check fails, what the verified links connect with either line is compared once more, with the texts. That loses no link:
    candidates of different groups that the forest leaves out are joined in it by a path, which leaves the group of either one by a
    failed check between two groups."""
    found = materialize(candidates(reps, max_distance, min_similarity).distinct(), "candidates")
    rough = materialize(connected_components(found), "rough")
    wanted = reps.join(checked_broadcast(rough.select("node")), F.col("id") == F.col("node")).select("id", F.col("first.row_key").alias("row_key"))
    texts = materialize(_texts(docs, materialize(wanted, "wanted")), "texts")
    checked = materialize(_verified(found, texts, min_similarity), "checked")
    good = checked.where("ok").select("a", "b")
    now = materialize(connected_components(good).select(F.col("node").alias("n"), F.col("root").alias("label")), "labels")
    label = lambda end: checked_broadcast(now.withColumnsRenamed({"n": end, "label": f"label_{end}"}))
    failed = checked.where("not ok").join(label("a"), "a", "left").join(label("b"), "b", "left")
    failed = failed.select(F.coalesce("label_a", "a").alias("x"), F.coalesce("label_b", "b").alias("y")).where("x <> y")
    bad = materialize(failed.select(F.explode(F.array("x", "y")).alias("label")).distinct(), "failed")
    if not bad.isEmpty():
        labelled = rough.select(F.col("node").alias("id")).join(now, F.col("id") == F.col("n"), "left").select("id", F.coalesce("label", "id").alias("label"))
        still = materialize(labelled.join(checked_broadcast(bad), "label", "left_semi"), "open")
        again = materialize(reps.select("id", "sketch").join(checked_broadcast(still), "id"), "open-lines")
        good = good.union(_rest(again, texts, max_distance, min_similarity))
    out = materialize(connected_components(good).join(texts.select(F.col("id").alias("node"), "h2"), "node"), "groups")
    for done in (found, rough, texts, checked):
        release(done)
    return out


def removed_lines(docs: DataFrame, max_distance: int = MAX_DISTANCE, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """row_key and removed (sorted line numbers) of the rows of with_row_key() that lose lines: each group of lines that are alike
    keeps its first occurrence, by doc_id, row_key and line number."""
    lines = materialize(line_table(docs), "lines")
    first = F.min(F.struct("doc_id", "row_key", "line")).alias("first")
    reps = materialize(lines.groupBy("h1", "h2").agg(first, F.min("sketch").alias("sketch"), F.count("*").alias("copies")).select(F.col("h1").alias("id"), "h2", "sketch", "first", "copies"), "reps")
    drop_shuffles(docs.sparkSession)
    found = groups(reps, docs, max_distance, min_similarity).withColumnRenamed("h2", "other")
    # what goes: all but the first occurrence of a line, and the first ones of those that have a like one before them
    member = materialize(reps.join(checked_broadcast(found), (F.col("id") == F.col("node")) & (F.col("h2") == F.col("other"))).select("root", "first"), "members")
    best = member.groupBy("root").agg(F.min("first").alias("best")).withColumnRenamed("root", "r")
    later = member.join(checked_broadcast(best, 250_000), F.col("root") == F.col("r")).where("first <> best").select("first.row_key", "first.line")
    copied = reps.where("copies > 1").select(F.col("id").alias("i"), F.col("h2").alias("j"), F.col("first.row_key").alias("k"), F.col("first.line").alias("l"))
    is_first = (F.col("row_key") == F.col("k")) & (F.col("line") == F.col("l"))
    if copied.limit(MAX_COPIED + 1).count() <= MAX_COPIED:
        repeats = lines.join(F.broadcast(copied), (F.col("h1") == F.col("i")) & (F.col("h2") == F.col("j"))).where(~is_first).select("row_key", "line")
    else:  # by row and line, so that a line of many copies is spread over the tasks
        firsts = reps.select(F.col("first.row_key").alias("k"), F.col("first.line").alias("l"))
        repeats = lines.select("row_key", "line").join(firsts, is_first, "left_anti")
    gone = materialize(repeats.union(later).groupBy("row_key").agg(F.array_sort(F.collect_set("line")).alias("removed")), "removed")
    for done in (lines, reps, member):
        release(done)
    return gone


@F.pandas_udf(StringType())
def _without(text: pd.Series, removed: pd.Series) -> pd.Series:
    """Texts less the lines of these numbers."""
    out = []
    for t, gone in zip(text, removed):
        drop = set(gone.tolist())
        out.append("\n".join([x for i, x in enumerate(t.split("\n")) if i not in drop]))
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, max_distance: int = MAX_DISTANCE, min_similarity: float = MIN_SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text less the lines that are like an earlier one, and with the columns n_lines and removed (line numbers,
    from 0) after their own; columns of these names are replaced.

    Lines are alike if they are the same when normalized (lower case, runs of signs and spaces one space), or linked through lines
    whose edit similarity is at least min_similarity and whose fingerprints meet: they share a block, and differ in at most
    max_distance of their first COMPARED bits. Lines of signs and spaces alone stay. A text that loses all its lines is empty; null texts
    stay null, with no lines. Rows that share doc_id and text share the decision, as one document; rows without doc_id come first.
    Of two lines whose 128-bit hashes agree in one half by chance, only one is compared with others."""
    own = with_row_key(docs, id_col, text_col)
    gone = removed_lines(own, max_distance, min_similarity)
    row_key, other, out = (unused(docs, x) for x in ("row_key", "other_key", "gone"))
    key = F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    size = gone.agg(F.coalesce(F.sum(F.size("removed") * 4 + 64), F.lit(0))).first()[0]
    named = gone.withColumnsRenamed({"row_key": other, "removed": out})
    joined = docs.withColumn(row_key, key).join(F.broadcast(named) if size <= 16 << 20 else named, F.col(row_key) == F.col(other), "left")  # 16 MB at most
    text = F.col(text_col).cast("string")
    n_lines = F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1).cast("int")
    left = F.when(F.col(out).isNull(), F.col(text_col)).otherwise(_without(F.when(F.col(out).isNull(), "").otherwise(text), F.coalesce(out, F.array().cast("array<int>"))))
    columns = [left.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "removed")]
    return joined.select(*columns, n_lines.alias("n_lines"), F.coalesce(out, F.array().cast("array<int>")).alias("removed"))
