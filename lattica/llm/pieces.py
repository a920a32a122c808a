"""SentencePiece (BPE) encoding and decoding by suffix-array matching: the batch's text is indexed, every piece is searched for by
bisection, the edges found are sorted by position and then relaxed."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, buffers, sliced

#: Bytes of text, and of different segments, that are taken at once.
TEXT_BYTES, CHUNK_BYTES = 4 << 20, 1 << 18
NEVER = np.int64(1) << 40
#: Edges of a step of the relaxation up to which they are taken one by one.
FEW_EDGES = 48
#: Bytes or ids that gather() copies at once; each takes 24 bytes meanwhile.
GATHERED = 1 << 17


class Model(NamedTuple):
    """A BPE vocabulary, with what the relaxation needs to know of it. Symbols are pieces and, from n on, characters that pieces are
    made of without being one."""

    n: int
    pieces: list  # bytes of each symbol, with the space mark as a space; empty where text never matches (control, byte pieces)
    text: list  # bytes that each id decodes to
    byte_ids: np.ndarray  # id of each byte's piece, or of the unknown piece
    usable: np.ndarray  # symbols that may be edges: encoding a piece's own text gives the piece
    single: np.ndarray  # ASCII bytes that are part of no piece
    joined: np.ndarray  # keys (left symbol, right symbol) that make a piece, sorted
    joined_rank: np.ndarray
    joined_to: np.ndarray
    right: np.ndarray  # the symbols that end a piece while it is merged, one row per symbol, -1 beyond
    right_from: np.ndarray  # when each of them is made, and when it is merged further
    right_until: np.ndarray
    left: np.ndarray  # the same for those that begin it
    left_from: np.ndarray
    left_until: np.ndarray
    low: np.ndarray  # for each usable symbol, the least and the greatest eight bytes that begin with it (or that it begins with)
    high: np.ndarray


def merge(symbols: list[bytes], rank: dict[bytes, int]) -> tuple[list[bytes], list[tuple[int, int]]]:
    """BPE of a list of characters: the adjacent two that make the piece of the least rank (the first two, in a tie) become one, until
    no two make a piece. Also the place and rank of each step."""
    symbols, steps = list(symbols), []
    while True:
        best = min(((r, i) for i in range(len(symbols) - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None), default=None)
        if best is None:
            return symbols, steps
        r, i = best
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        steps.append((i, r))


def _edge(parts: list[bytes], rank: dict[bytes, int], right: bool) -> list[tuple[bytes, int, int]]:
    """The symbols that end (or begin) a text while it is merged: each with the times at which it is made and merged further. Time is
    the greatest rank merged so far: a piece waits for the lowest rank that is to be had, wherever that is."""
    symbols, now, out = list(parts), -1, []
    made = -1
    for i, r in merge(parts, rank)[1]:
        now = max(now, r)
        touched = i + 1 == len(symbols) - 1 if right else i == 0
        if touched:
            out.append((symbols[-1] if right else symbols[0], made, now))
            made = now
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    out.append((symbols[-1] if right else symbols[0], made, int(NEVER)))
    return out


def characters(text: bytes) -> list[bytes]:
    return [c.encode() for c in text.decode()]


def load(path: str) -> Model:
    """Reads a model file. Models whose pieces go on after a space, or that normalize text, aren't supported."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
    pieces = [names[i].replace("▁", " ").encode() if plain[i] else b"" for i in range(n)]
    if any(b" " in p.lstrip(b" ") for p in pieces):
        raise ValueError("a piece has a space inside")
    byte_ids = np.full(256, sp.unk_id())
    text = [p for p in pieces]
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(names[i][3:5], 16)] = i
            text[i] = bytes([int(names[i][3:5], 16)])
    text[sp.unk_id()] = " ⁇ ".encode()
    scores = [sp.get_score(i) for i in range(n)]
    order = {s: k for k, s in enumerate(sorted({scores[i] for i in range(n) if pieces[i]}, reverse=True))}
    rank = {pieces[i]: order[scores[i]] for i in range(n) if pieces[i]}
    symbol = {p: i for i, p in enumerate(pieces) if p}
    every = sorted({c for p in pieces if p for c in characters(p)} - set(symbol))
    for c in every:
        symbol[c] = len(pieces)
        pieces.append(c)
    size = len(pieces)
    usable = np.zeros(size, bool)
    rows: dict[bool, list] = {True: [], False: []}
    keys, ranks, to = [], [], []
    for i, p in enumerate(pieces):
        parts = characters(p) if p else []
        for k in range(1, len(parts)):
            a, b = symbol.get(b"".join(parts[:k])), symbol.get(b"".join(parts[k:]))
            if a is not None and b is not None:
                keys.append(a * size + b)
                ranks.append(rank[p])
                to.append(i)
        usable[i] = bool(p) and merge(parts, rank)[0] == [p]
        for side in rows:
            rows[side].append([(symbol[s], x, y) for s, x, y in _edge(parts, rank, side)] if usable[i] else [])
    by = np.argsort(keys)

    def matrix(side: bool, field: int, empty: int) -> np.ndarray:
        out = np.full((size + 1, max(len(r) for r in rows[side])), empty, np.int64)  # the last row: what merges with nothing
        for i, r in enumerate(rows[side]):
            out[i, : len(r)] = [x[field] for x in r][::-1]
        return out

    single = np.ones(256, bool)
    single[128:] = False
    single[list(set(b"".join(pieces)) & set(range(128)))] = False
    spines = [matrix(side, field, -1) for side in (True, False) for field in range(3)]
    bounds = [np.array([int.from_bytes(pieces[i][:8].ljust(8, fill), "big") for i in np.flatnonzero(usable)], np.uint64) for fill in (b"\0", b"\xff")]
    return Model(n, pieces, text, byte_ids, usable, single, np.array(keys)[by], np.array(ranks)[by], np.array(to)[by], *spines, *bounds)


def compatible(model: Model, u: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether BPE of piece u's text and piece t's, one after the other, gives u and t: while both are merged, no symbol that ends
    the left one and no symbol that begins the right one stand side by side when their own merge is the next one."""
    size = len(model.pieces)
    keys, inverse = np.unique(u * (size + 1) + t, return_inverse=True)
    u, t = keys // (size + 1), keys % (size + 1)
    fine = np.ones(len(u), bool)
    for i in range(model.right.shape[1]):
        a = model.right[u, i]
        some = np.flatnonzero((a >= 0) & fine)
        if not len(some):
            continue
        for j in range(model.left.shape[1]):
            us, ts = u[some], t[some]
            b = model.left[ts, j]
            meet = (b >= 0) & (model.right_from[us, i] < model.left_until[ts, j]) & (model.left_from[ts, j] < model.right_until[us, i])
            if not meet.any():
                continue
            x = some[meet]
            key = a[x] * size + b[meet]
            at = np.minimum(np.searchsorted(model.joined, key), len(model.joined) - 1)
            hit = model.joined[at] == key
            x, at = x[hit], at[hit]
            when = np.maximum(np.maximum(model.right_from[u[x], i], model.left_from[t[x], j]), model.joined_rank[at])
            fine[x[(when < model.right_until[u[x], i]) & (when <= model.left_until[t[x], j])]] = False
    return fine[inverse]


def occurrences(model: Model, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and symbol of each place where a usable piece stands in the text: its suffixes are sorted, as far as the longest piece
    goes, and each piece's range is found by bisection."""
    ids = np.flatnonzero(model.usable)
    pieces = [model.pieces[i] for i in ids]
    longest = max((len(p) for p in pieces), default=0)
    padded = np.r_[raw, np.zeros(longest + 24, np.uint8)].tobytes()
    view = lambda skip: np.ndarray((len(raw),), ">u8", buffer=padded, offset=skip, strides=(1,))
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    k1, k2 = view(0)[starts].astype(np.uint64), view(8)[starts].astype(np.uint64)
    order = np.lexsort((k2, k1))
    order, k1, k2 = starts[order], k1[order], k2[order]
    # suffixes that are still tied are sorted by what follows, eight bytes at a time
    tied = np.arange(len(order))
    same = np.r_[False, (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])] if len(order) else np.zeros(0, bool)
    for skip in range(16, longest, 8):
        tied = tied[same | np.r_[same[1:], False]]
        if not len(tied):
            break
        group = np.cumsum(~same[same | np.r_[same[1:], False]])
        key = view(skip)[order[tied]].astype(np.uint64)
        by = np.lexsort((key, group))
        order[tied], key = order[tied][by], key[by]
        same = np.r_[False, (group[1:] == group[:-1]) & (key[1:] == key[:-1])]
    low, high = np.searchsorted(k1, model.low, "left"), np.searchsorted(k1, model.high, "right")
    more = [i for i in np.flatnonzero(high > low).tolist() if len(pieces[i]) > 8]
    for i in more:
        p, s, e = pieces[i], low[i], high[i]
        part = k2[s:e]
        low[i] = s + np.searchsorted(part, np.uint64(int.from_bytes(p[8:16].ljust(8, b"\0"), "big")), "left")
        high[i] = s + np.searchsorted(part, np.uint64(int.from_bytes(p[8:16].ljust(8, b"\xff"), "big")), "right")
        if len(p) > 16 and high[i] > low[i]:
            places, text = range(low[i], high[i]), lambda k, n=len(p): padded[order[k] : order[k] + n]
            low[i], high[i] = low[i] + bisect_left(places, p, key=text), low[i] + bisect_right(places, p, key=text)
    many = np.maximum(high - low, 0)
    at = order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    return at, np.repeat(ids, many)


def relax(model: Model, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of each segment off[i]:off[i + 1], joined, and their offsets.

    BPE of a text that ends at some place is BPE of what comes before its last symbol, and that symbol; so each place has one last
    symbol, the one that is compatible with the last symbol of the place where it starts. Edges are relaxed in order of the place
    at which they end, in all segments at once; these are first cut where no piece crosses. Characters that are no symbol stand for themselves (symbol len(pieces))."""
    other, given = len(model.pieces), off
    kind = np.int32 if len(raw) < 1 << 30 else np.int64  # there are several edges a byte
    start, which = (x.astype(kind) for x in occurrences(model, raw))
    length = np.array([len(p) for p in model.pieces] + [0], kind)
    # where no piece crosses, nothing is merged, and a segment falls into several
    segment = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = np.flatnonzero(length[which] > 1)
    finish = start[inside] + length[which[inside]]
    within = segment[start[inside]] == segment[np.minimum(finish, len(raw)) - 1]
    inside, finish = inside[within], finish[within]
    first, end = (np.bincount(x, minlength=len(raw) + 2) for x in (start[inside] + 1, finish))
    free = np.cumsum(first - end)[: len(raw)] == 0
    free &= (raw & 0xC0) != 0x80
    off = np.union1d(np.flatnonzero(free), off)
    n, size = len(off) - 1, np.diff(off)
    segment = np.repeat(np.arange(n, dtype=kind), size)
    del inside, finish, within, first, end, free
    # a character that is no usable piece is an edge too
    lead = np.flatnonzero((raw & 0xC0) != 0x80).astype(kind)
    alone = np.ones(len(raw) + 1, bool)
    wide = np.diff(np.r_[lead, len(raw)])
    covered = start[length[which] == wide[np.searchsorted(lead, start)]]
    alone[covered] = False
    bare = lead[alone[lead]]
    where = np.r_[start, bare]
    which = np.r_[which, np.full(len(bare), other, kind)]
    to = where + np.r_[length[which[: len(start)]], wide[alone[lead]]]
    del start, lead, alone, wide, covered, bare
    inside = to <= off[segment[where] + 1] if len(where) else np.zeros(0, bool)
    where, which, to = where[inside], which[inside], to[inside]
    seg = segment[where]
    reach = (to - off[seg]).astype(kind)
    by = np.argsort(reach, kind="stable")
    where, which, seg, reach = where[by] + seg[by], which[by], seg[by], reach[by]  # a segment has a node more than bytes
    to = to[by] + seg
    del segment, inside, by
    last = np.full(len(raw) + n, -1, np.int64)
    origin = np.zeros(len(raw) + n, np.int64)
    first = off[:-1] + np.arange(n)
    last[first] = other + 1
    cuts = np.r_[0, np.flatnonzero(np.diff(reach)) + 1, len(reach)] if len(reach) else np.zeros(1, np.int64)
    doubtful = np.zeros(n, bool)
    known: dict[tuple[int, int], bool] = {}
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if e - s <= FEW_EDGES:  # the long segments that are left: one by one, as most pairs have been met before
            for start_at, t, end_at, k in zip(where[s:e].tolist(), which[s:e].tolist(), to[s:e].tolist(), seg[s:e].tolist()):
                u = int(last[start_at])
                if u < 0:
                    continue
                if u < other and t < other and (u, t) not in known:
                    known[u, t] = bool(compatible(model, np.array([u]), np.array([t]))[0])
                if u >= other or t >= other or known[u, t]:
                    doubtful[k] |= last[end_at] >= 0
                    last[end_at], origin[end_at] = t, start_at
            continue
        u, t = last[where[s:e]], which[s:e]
        alive = np.flatnonzero(u >= 0)
        u, t = u[alive], t[alive]
        free = (u >= other) | (t >= other)
        ok = free.copy()
        ok[~free] = compatible(model, u[~free], t[~free])
        hit = alive[ok] + s
        doubtful[seg[hit][last[to[hit]] >= 0]] = True
        last[to[hit]] = which[hit]
        origin[to[hit]] = where[hit]
        if len(hit) > 1:
            again = np.sort(to[hit])
            twice = again[1:][again[1:] == again[:-1]]
            doubtful[segment_of(twice, off)] = True
    end = off[1:] + np.arange(n)
    doubtful |= (last[end] < 0) & (size > 0)
    # back from each end
    node, live, back, owner = end.copy(), np.flatnonzero((size > 0) & ~doubtful), [], []
    while len(live):
        back.append(last[node[live]])
        owner.append(live)
        node[live] = origin[node[live]]
        live = live[node[live] != first[live]]
    symbols = np.concatenate(back[::-1]) if back else np.zeros(0, np.int64)
    owners = np.concatenate(owner[::-1]) if owner else np.zeros(0, np.int64)
    extra_s, extra_o = [], []
    if doubtful.any():  # ties of rank that times can't tell apart: merged one by one
        names = {p: i for i, p in enumerate(model.pieces) if p}
        rank = {model.pieces[i]: int(r) for i, r in zip(model.joined_to, model.joined_rank)}
        for i in np.flatnonzero(doubtful).tolist():
            got = [names.get(x, other) for x in merge(characters(raw[off[i] : off[i + 1]].tobytes()), rank)[0]]
            extra_s += got
            extra_o += [i] * len(got)
    symbols, owners = np.r_[symbols, np.array(extra_s, np.int64)], np.r_[owners, np.array(extra_o, np.int64)]
    by = np.argsort(owners, kind="stable")
    return symbols[by], np.r_[0, np.cumsum(np.bincount(owners, minlength=n))].astype(np.int64)[np.searchsorted(off, given)]


def segment_of(nodes: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.searchsorted(off[:-1] + np.arange(len(off) - 1), nodes, "right") - 1


def gather(values: np.ndarray, off: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices off[i]:off[i + 1] of values for each i of which, joined, and how long each is. Only some GATHERED places, or one
    slice, are worked out at a time: those of all would take many times the memory of the result."""
    size = np.diff(off)[which]
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, values.dtype)
    i = 0
    while i < len(which):
        begin = int(end[i] - size[i])
        j = max(i + 1, int(np.searchsorted(end, begin + GATHERED, "right")))
        part, last = size[i:j], int(end[j - 1])
        out[begin:last] = values[np.repeat(off[which[i:j]] - (end[i:j] - part), part) + np.arange(begin, last)]
        i = j
    return out, size


def encode(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, joined, and their offsets. Null and empty texts have none."""
    marked = pc.replace_substring(pc.fill_null(texts, ""), "▁", " ")
    marked = pc.if_else(pc.equal(marked, ""), "", pc.binary_join_element_wise(" ", marked, ""))
    raw, off = buffers(marked)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    # no piece goes over a space that follows something else, or holds a byte that is in no piece
    space, alone = raw == 0x20, model.single[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    cut[off] = True
    at = np.flatnonzero(cut)
    del space, alone, cut
    words = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64, copy=False)), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
    of_text = np.searchsorted(at, off)  # the first segment of each text
    del at, raw, marked
    segment = words.indices.to_numpy(zero_copy_only=False)
    parts, counts = [], []
    for b in sliced(iter([pa.RecordBatch.from_arrays([words.dictionary], ["s"])]), "s", CHUNK_BYTES):
        data, bound = buffers(b.column("s"))
        symbols, where = relax(model, data, bound)
        # characters that are no piece become the pieces of their bytes
        plain = symbols < model.n
        size = np.ones(len(symbols), np.int64)
        if not plain.all():
            text = data.tobytes()
            owner = np.repeat(np.arange(len(bound) - 1), np.diff(where))
            spread = {}
            for i in np.unique(owner[~plain]).tolist():
                at_byte = int(bound[i])
                for k in range(int(where[i]), int(where[i + 1])):
                    s = int(symbols[k])
                    if s < model.n:
                        at_byte += len(model.pieces[s])
                        continue
                    step = 1 if text[at_byte] < 0x80 else 2 if text[at_byte] < 0xE0 else 3 if text[at_byte] < 0xF0 else 4
                    spread[k] = model.byte_ids[list(text[at_byte : at_byte + step])]
                    at_byte += step
                    size[k] = step
            out = np.repeat(symbols, size)
            begin = np.cumsum(size) - size
            for k, ids in spread.items():
                out[begin[k] : begin[k] + len(ids)] = ids
            total = np.r_[0, np.cumsum(size)]
            symbols, where = out, total[where]
        parts.append(symbols.astype(np.int32))
        counts.append(np.diff(where))
    ids, size = gather(np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(counts))], segment)
    return ids, np.r_[0, np.cumsum(size)][of_text]


def decode(model: Model, ids: np.ndarray, off: np.ndarray) -> list[str]:
    """Texts of joined ids: without the space that encoding puts first; bytes that are no UTF-8 become U+FFFD."""
    bounds = np.r_[0, np.cumsum([len(t) for t in model.text])]
    text = np.frombuffer(b"".join(model.text), np.uint8)
    out, i = [], 0
    while i < len(off) - 1:  # some texts at a time
        j = max(i + 1, int(np.searchsorted(off, off[i] + GATHERED, "right")) - 1)
        raw, size = gather(text, bounds, ids[off[i] : off[j]])
        total = np.r_[0, np.cumsum(size)][off[i : j + 1] - off[i]].tolist()
        data = raw.tobytes()
        out += [data[s:e].removeprefix(b" ").decode("utf-8", "replace") for s, e in zip(total[:-1], total[1:])]
        i = j
    return out


def shared_model(spark: SparkSession, path: str):
    """The model as a broadcast: some 20 MB, as large as its vocabulary makes it."""
    return spark.sparkContext.broadcast(load(path))


def with_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, token_ids and decoded_md5 (of the text that the ids decode to) of each row's whole text, under the BPE model
    in the file `path`, which only the driver reads.

    The ids are those of the SentencePiece library without start and end marks. Decoding gives the text back, with U+2581 as a
    space. Null and empty texts have no tokens; rows without doc_id and repeated rows are returned as they come; other columns are
    ignored."""
    model = shared_model(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", TEXT_BYTES):
            ids, off = encode(model.value, b.column("text"))
            said = [hashlib.md5(t.encode()).hexdigest() for t in decode(model.value, ids, off)]
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off)), lists, pa.array(said, pa.string())], ["doc_id", "n_tokens", "token_ids", "decoded_md5"])

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.transform(arrow_map, run, "doc_id bigint, n_tokens bigint, token_ids array<int>, decoded_md5 string")
