"""Quality rules on repetition inside a text, from a suffix array of its words and the longest-common-prefix intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, buffers, sliced, words

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, covered_words bigint, covered_fraction double, longest_repeat bigint, n_maximal_repeats bigint"
)


def suffix_array(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of several sequences (ids >= 0; sequence i is first[i]:first[i + 1]), sorted by sequence and then by what they say,
    and the length of each one's common prefix with the one before it (0 across sequences; lengths of 1 may be given as 0).

    Prefix doubling: a first sort settles two ids, each further one twice as many, and only of the suffixes that are still tied.
    The ranks of each round are kept, and give the common prefixes by halving steps."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(first)
    seq = np.repeat(np.arange(len(size)), size)
    stop = np.repeat(first[1:], size)
    wide = int(ids.max()).bit_length() + 1
    here = ids.astype(np.uint64) + np.uint64(1)
    after = np.zeros(n, np.uint64)
    after[:-1] = here[1:]
    after[stop - 1 == np.arange(n)] = 0
    if 2 * wide + int(seq[-1]).bit_length() > 64:  # more distinct ids than a word has room for
        key = np.unique((seq.astype(np.uint64) << np.uint64(wide)) | here, return_inverse=True)[1].astype(np.uint64)
        key = (key << np.uint64(wide)) | after
    else:
        key = (((seq.astype(np.uint64) << np.uint64(wide)) | here) << np.uint64(wide)) | after
    order = np.argsort(key, kind="stable")
    ranks: list[np.ndarray] = []
    tied = np.arange(n)  # places of the order that are not settled
    sort_key = key[order]
    rank = np.empty(n, np.int64)
    length = 2
    while True:
        head = np.r_[True, sort_key[1:] != sort_key[:-1]] if len(tied) else np.zeros(0, bool)
        lead = tied[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))] if len(tied) else tied
        rank = rank.copy()
        rank[order[tied]] = lead
        ranks.append(rank)
        alone = head & np.r_[head[1:], True] if len(tied) else head
        tied = tied[~alone]
        if not len(tied):
            break
        p = order[tied]
        q = p + length
        further = np.where(q < stop[p], rank[np.minimum(q, n - 1)] + 1, 0)
        sort_key = (rank[p].astype(np.uint64) << np.uint64(32)) | further.astype(np.uint64)
        by = np.argsort(sort_key, kind="stable")
        order[tied] = p[by]
        sort_key = sort_key[by]
        length *= 2
    lcp = np.zeros(n, np.int64)
    pair = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    p, q, got = order[pair - 1], order[pair], np.zeros(len(pair), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = p + got, q + got
        inside = (a < stop[p]) & (b < stop[q])
        same = np.zeros(len(pair), bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        got[same] += 2 << k
    a, b = p + got, q + got
    inside = (a < stop[p]) & (b < stop[q])
    got[inside] += ids[a[inside]] == ids[b[inside]]
    lcp[pair] = got
    return order, lcp


def spans(order: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where repeated substrings of at least `least` ids start, and how long the longest one is from there. A suffix's longest
    repeat is the deeper of the two LCP intervals that it lies in with its neighbours; all occurrences of all maximal repeats
    are covered by these spans."""
    deepest = np.maximum(lcp, np.r_[lcp[1:], 0]) if len(lcp) else lcp
    at = np.flatnonzero(deepest >= least)
    return order[at], deepest[at]


def intervals(order: np.ndarray, lcp: np.ndarray, ids: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """For each sequence, how many LCP intervals of depth >= least are maximal repeats: their suffixes are not all preceded by the
    same id, so that they can't be extended to the left. Open intervals stand in a stack by depth; one that closes hands what
    precedes its suffixes (one id, or several) to the one around it."""
    n = len(first) - 1
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return np.zeros(n, np.int64)
    left = np.full(len(ids), -1, np.int64)
    left[1:] = ids[:-1]
    left[first[:-1][first[:-1] < len(ids)]] = -1  # what begins a sequence is preceded by nothing, which no other suffix of it is
    several = -2
    start = np.flatnonzero(np.r_[True, np.diff(deep) > 1])
    seq = np.searchsorted(first, order[deep[start]], "right") - 1
    own, depth, out = left[order].tolist(), lcp.tolist(), np.zeros(n, np.int64)
    for s, e, k in zip(deep[start].tolist(), np.r_[deep[start[1:] - 1], deep[-1]].tolist(), seq.tolist()):
        stack: list[list[int]] = []
        found = 0
        for i in range(s, e + 2):
            d, state = depth[i] if i <= e else -1, own[i - 1]
            while stack and stack[-1][0] > d:
                inner = stack.pop()[1]
                state = state if state == inner else several
                found += state == several
            if i > e:
                break
            if stack and stack[-1][0] == d:
                if stack[-1][1] != state:
                    stack[-1][1] = several
            else:
                stack.append([d, state])
        out[k] += found
    return out


def union(start: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many places of each sequence the spans cover."""
    n = int(first[-1])
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, start + length, -1)
    covered = np.zeros(n + 1, np.int64)
    np.cumsum(np.cumsum(delta[:-1]) > 0, out=covered[1:])
    return covered[first[1:]] - covered[first[:-1]]


def counted(marks: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of the marked bytes each text has."""
    return np.diff(np.searchsorted(np.flatnonzero(marks), off))


def duplicate_lines(raw: np.ndarray, off: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """For each text the number of `\\n`-split lines that have a word and equal an earlier line."""
    breaks = raw == 0x0A
    cut = np.flatnonzero(breaks)
    start = np.sort(np.r_[off[:-1], cut + 1], kind="stable")
    owner = np.searchsorted(off, start, "right") - 1
    # an empty text and a text that ends in a line break start a line where the next text starts one; the empty ones have no word
    end = np.r_[start[1:], len(raw)]
    has = np.searchsorted(word_at, end) > np.searchsorted(word_at, start)
    compact = np.cumsum(~breaks)
    compact = np.r_[0, compact]
    at = np.r_[compact[start], compact[-1]].astype(np.int64)
    lines = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw[~breaks])))
    code = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = (owner * (len(start) + 1) + code)[has]
    distinct = np.unique(key) // (len(start) + 1)
    n = len(off) - 1
    return np.bincount(owner[has], minlength=n) - np.bincount(distinct, minlength=n)


def measures(texts: pa.Array, window: int = 8, min_repeat: int = 4, unit: str = "word") -> dict[str, np.ndarray]:
    """The counts of each text of a column. unit: "word", or "char" for scripts that do not space their words; it is what
    covered_words, longest_repeat and n_maximal_repeats count in."""
    raw, off = buffers(texts)
    w = words(raw, off)
    ids, _ = w.encoded()
    order, lcp = suffix_array(ids, w.first)
    n = np.diff(w.first)
    out = {"n_words": n, "word_chars": np.diff(w.off[w.first]) - counted((raw & 0xC0) == 0x80, off)}
    out |= {"n_symbols": counted(SYMBOLS[raw], off), "n_dup_lines": duplicate_lines(raw, off, w.at)}
    out["n_repeat_words"] = union(*spans(order, lcp, window), w.first)
    first, total = w.first, n
    if unit == "char":
        text = raw.tobytes().decode("utf-8", "replace")
        ids = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][off]
        total = np.diff(first)
        order, lcp = suffix_array(ids, first)
    at, length = spans(order, lcp, min_repeat)
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, np.searchsorted(first, at, "right") - 1, length)
    out["covered_words"] = union(at, length, first)
    out["covered_fraction"] = out["covered_words"] / np.maximum(total, 1)
    out["longest_repeat"] = longest
    out["n_maximal_repeats"] = intervals(order, lcp, ids, first, min_repeat)
    return out


def repetition(docs: DataFrame, window: int = 8, min_repeat: int = 4, max_covered: float = 0.5, max_longest: int = 100, unit: str = "word", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs with the counts of its whole text, whether the base rule fails it (under 20 words, or over 30 %
    of the words in 8-word windows that come twice) and whether it is kept.

    kept: the base rule doesn't fail, repeated substrings of at least min_repeat words cover at most max_covered of the words,
    and the longest one has at most max_longest words. Null and empty texts have no words and fail the base rule; rows without
    doc_id and repeated rows are returned as they come; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            m = measures(b.column("text"), window, min_repeat, unit)
            m["base_failed"] = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
            m["kept"] = ~m["base_failed"] & (m["covered_fraction"] <= max_covered) & (m["longest_repeat"] <= max_longest)
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(m[x]) for x in names[1:])], names)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(arrow_map, run, SCHEMA)
