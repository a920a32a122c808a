"""Benchmark decontamination by the q-gram lemma: shared q-grams are counted in overlapping diagonal bands, and the regions that an
edit budget can't rule out are verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, buffers, normalized, sliced

#: Characters (bytes) of a q-gram; items that are too short for that many take shorter ones.
Q, RATE = 8, 0.1
#: Benchmark bytes that are searched for in one pass over the documents. A larger benchmark takes several passes, so that what a
#: task holds is bounded.
BLOCK_BYTES = 4 << 20
FILTER_BITS, BIN_BITS = 20, 20


def codes(raw: np.ndarray, q: int = Q) -> np.ndarray:
    """The q (at most 8) bytes from each place on, as an integer."""
    n = max(len(raw) - q + 1, 0)
    eight = np.ndarray((n,), "<u8", buffer=np.r_[raw, np.zeros(8, np.uint8)].tobytes(), strides=(1,))
    return eight & np.uint64((1 << 8 * q) - 1)


def slot(code: np.ndarray) -> np.ndarray:
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


def align(item: np.ndarray, region: np.ndarray, low: int, high: int, budget: int) -> int:
    """The least edit distance between the item and any part of the region, over alignments whose diagonals (place in the region
    less place in the item) lie in low..high; budget + 1 if it is more than the budget."""
    wide, n, none = high - low + 1, len(region), budget + 1
    step = np.arange(wide)
    at = low + step  # column of each diagonal in the current row
    row = np.where((at >= 0) & (at <= n), 0, none)
    for i, c in enumerate(item):
        at = at + 1  # row i + 1: diagonal d stands at column i + 1 + d
        inside = (at >= 1) & (at <= n)
        same = np.zeros(wide, bool)
        same[inside] = region[at[inside] - 1] == c
        new = np.where(inside, row + ~same, none)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # a character of the item that the region lacks
        new[(at < 0) | (at > n)] = none
        new = np.minimum.accumulate(new - step) + step  # characters of the region that the item lacks
        new[(at < 0) | (at > n)] = none
        row = np.minimum(new, none)
        if row.min() >= none:
            return none
    return int(row.min())


class Index:
    """A block of benchmark items. An item's edit budget e is `rate` of its length; it takes q-grams of at most size / (e + 1) bytes,
    of which a text within the budget shares one at least. Items that take the same q are searched for together."""

    def __init__(self, ids: list, texts: list[str], rate: float):
        self.ids = ids
        raw, off = normalized(*buffers(pa.array(texts, pa.string())))
        size = np.diff(off)
        budget = (rate * size + 1e-9).astype(np.int64)
        q = np.minimum(Q, size // (budget + 1))
        if (q[size > 0] < 1).any():
            raise ValueError("the rate is too high for the lemma")
        self.parts = []
        for k in np.unique(q[q > 0]).tolist():
            which = np.flatnonzero(q == k)
            self.parts.append(Grams(which, [raw[off[i] : off[i + 1]] for i in which], budget[which], k))

    def search(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, item number and distance of each pair of a text and an item that some part of it is within the budget of."""
        raw, off = normalized(*buffers(texts))
        found = sorted(x for part in self.parts for x in part.search(raw, off))
        out = np.array(found, np.int64).reshape(-1, 3)
        return out[:, 0], out[:, 1], out[:, 2]


class Grams:
    """The q-grams of some items, and how many of them a text shares that is within an item's budget."""

    def __init__(self, which: np.ndarray, items: list[np.ndarray], budget: np.ndarray, q: int):
        self.which, self.items, self.budget, self.q = which, items, budget, q
        self.size = np.array([len(x) for x in items], np.int64)
        self.least = self.size - q + 1 - q * budget
        grams = [codes(x, q) for x in items]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.codes, self.first = np.unique(every[order], return_index=True)
        self.first = np.r_[self.first, len(every)]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[slot(self.codes)] = True

    def search(self, raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
        best: dict[tuple[int, int], int] = {}
        if len(raw) >= self.q and len(self.codes):
            code = codes(raw, self.q)
            at = np.flatnonzero(self.filter[slot(code)])
            which = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
            real = self.codes[which] == code[at]
            at, which = at[real], which[real]
            many = self.first[which + 1] - self.first[which]
            at = np.repeat(at, many)
            entry = np.repeat(self.first[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            item = self.owner[entry]
            diagonal = at - self.place[entry]
            # bands of 2 (e + 1) diagonals that start every e + 1: the e + 1 that an alignment may use lie in one of them
            step = self.budget[item] + 1
            band = np.concatenate([diagonal // step, diagonal // step - 1])
            low = int(band.min()) if len(band) else 0
            span = int(band.max()) - low + 1 if len(band) else 1
            key, need = np.concatenate([item, item]) * span + (band - low), np.concatenate([self.least[item]] * 2)
            # bands are first counted in bins that several may share, which leaves few to be sorted; then each place of the item counts once
            bin_ = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
            full = np.bincount(bin_, minlength=1 << BIN_BITS)[bin_] >= need
            place = np.concatenate([self.place[entry]] * 2)[full]
            wide = int(self.size.max())
            key, count = np.unique(np.unique(key[full] * wide + place) // wide, return_counts=True)
            enough = count >= self.least[key // span]
            for i, b in zip((key[enough] // span).tolist(), (key[enough] % span + low).tolist()):
                e, m = int(self.budget[i]), int(self.size[i])
                whole = self.items[i].tobytes()
                start, stop = b * (e + 1), (b + 2) * (e + 1) + m
                first = max(0, int(np.searchsorted(off, start, "right")) - 1)
                for doc in range(first, min(len(off) - 1, int(np.searchsorted(off, stop, "left")))):
                    s, t = max(start, int(off[doc])), min(stop, int(off[doc + 1]))
                    if t - s < m - e or not best.get((doc, i), 1):
                        continue
                    region = raw[s:t]
                    if m < Q:  # so short an item counts only as words of their own
                        s, t = max(s - 1, int(off[doc])), min(t + 1, int(off[doc + 1]))
                        padded = (b" " if s == off[doc] else b"") + raw[s:t].tobytes() + (b" " if t == off[doc + 1] else b"")
                        d = 0 if b" " + whole + b" " in padded else e + 1
                    else:
                        d = 0 if whole in region.tobytes() else align(self.items[i], region, start - s, start - s + 2 * (e + 1) - 1, e)
                    if d <= e:
                        best[doc, i] = min(d, best.get((doc, i), d))
        return [(doc, int(self.which[i]), d) for (doc, i), d in best.items()]


def indexes(benchmark: DataFrame, rate: float, id_col: str, text_col: str) -> Iterator[Index]:
    """The benchmark in blocks of BLOCK_BYTES, in order of id; rows without text have nothing to search for."""
    ids, texts, held = [], [], 0
    for r in benchmark.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        held += len(r["t"])
        if held >= BLOCK_BYTES:
            yield Index(ids, texts, rate)
            ids, texts, held = [], [], 0
    if ids:
        yield Index(ids, texts, rate)


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per row of docs: doc_id, contaminated, items (sorted item ids whose text, normalized, is within its edit budget of a
    part of the whole document's) and distances.

    The budget is `rate` of the item's characters (UTF-8 bytes, normalized: lower case, runs of signs and spaces one space); items
    of under Q characters are found only as words of their own. Null and empty texts hold nothing, and an item of signs alone is
    nowhere; of items that share an id any counts, and an item without id is given as null; rows without doc_id and repeated rows
    are returned as they come; other columns are ignored."""
    kind = "doc_id bigint, text string, items array<bigint>, distances array<bigint>"
    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.array().cast("array<bigint>").alias("items"), F.array().cast("array<bigint>").alias("distances"))
    for index in indexes(benchmark, rate, "item_id" if item_col is None else item_col, "text"):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches, "text"):
                items, far = b.column("items").to_pylist(), b.column("distances").to_pylist()
                for doc, number, d in zip(*(x.tolist() for x in index.search(b.column("text")))):
                    item = index.ids[number]
                    if item in items[doc]:  # items may share an id
                        k = items[doc].index(item)
                        far[doc][k] = min(far[doc][k], d)
                    else:
                        items[doc].append(item)
                        far[doc].append(d)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(items, pa.list_(pa.int64())), pa.array(far, pa.list_(pa.int64()))], ["doc_id", "text", "items", "distances"])

        out = out.transform(arrow_map, run, kind)
    pairs = F.array_sort(F.arrays_zip("items", "distances"))
    out = out.select("doc_id", F.when(F.size("items") == 0, F.arrays_zip("items", "distances")).otherwise(pairs).alias("pairs"))
    return out.select("doc_id", (F.size("pairs") > 0).alias("contaminated"), F.transform("pairs", lambda p: p["items"]).alias("items"), F.transform("pairs", lambda p: p["distances"]).alias("distances"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text") -> DataFrame:
    """docs without the rows that leaks() finds contaminated; all columns stay."""
    out, schema = docs, docs.schema
    for index in indexes(benchmark, rate, "item_id", "text"):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches, text_col):
                clean = np.ones(b.num_rows, bool)
                clean[index.search(b.column(text_col))[0]] = False
                yield b.filter(pa.array(clean))

        out = out.transform(arrow_map, run, schema)
    return out
