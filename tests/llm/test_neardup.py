"""op2, op3 and op7 against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lattica.llm import buckets, components, decontam, lines, simhash
from lattica.llm.components import connected_components, local_forest, spanning_edges

SMALL = "/root/testdata/sf0.001"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def classes(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0d]+", low(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    texts = [None, "", " \n", "one", "One two", "a b c d e f g", "x " * 700, "é Ü ß a\tb\x0bc\x0cd", "a b c d e"]
    got = simhash.fingerprints(pa.array(texts, pa.string()))
    assert [int(x) & (1 << 64) - 1 for x in got] == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("rows", [4096, 8])
def test_fingerprint_classes(spark, rows, monkeypatch):
    monkeypatch.setattr(buckets, "BUCKET_ROWS", rows)
    rng = random.Random(5)
    fps = [0, 0]
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            fps.append(at)
            for _ in range(rng.randint(1, 5)):
                at ^= 1 << rng.randrange(64)
    ids = list(range(len(fps)))
    rng.shuffle(ids)
    want = classes(len(fps), [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for i, c in enumerate(want):
        least[c] = min(least.get(c, 10**9), ids[i])
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = dict(simhash.fingerprint_classes(spark.createDataFrame(list(zip(ids, signed)), "doc_id bigint, fp bigint")).collect())
    assert {s: least[c] for s, c in zip(signed, want)} == got


def test_near_duplicates(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    fps = [fingerprint(d.text) for d in docs]
    want = classes(len(docs), [(i, j) for i, j in combinations(range(len(docs)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for d, c in zip(docs, want):
        least[c] = min(least.get(c, 10**9), d.doc_id)
    got = simhash.near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted((d.doc_id, f"{f:016x}", least[c]) for d, f, c in zip(docs, fps, want))


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_components(spark, most, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", most)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7), (3, None)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    real = [e for e in edges if None not in e]
    want = classes(1201, real)
    assert got == {i: want[i] for i in {x for a, b in real if a != b for x in (a, b)}}
    a, b = (np.array(x) for x in zip(*real))
    for f in (local_forest, spanning_edges):
        x, y = f(a, b)
        assert classes(1201, zip(x.tolist(), y.tolist())) == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain(t):
    return re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", low(t)).strip(" ")


def test_normalized():
    from lattica.llm.common import buffers, normalized

    texts = ["", None, "  ", "A-b  C.", ".", "é!", "x", " 12 3 ", "?!", "a"]
    raw, off = normalized(*buffers(pa.array(texts, pa.string())))
    assert [raw[s:e].tobytes().decode() for s, e in zip(off[:-1], off[1:])] == [plain(t) for t in texts]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
    return row[-1]


MASK = (1 << 64) - 1


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & MASK
    return x ^ x >> 31


def word_hash(x):
    h = len(x)
    for k in (0, 8, 16):
        h = mixed(h * 0x9E3779B97F4A7C15 & MASK ^ int.from_bytes(x[k : k + 8], "little"))
    return h


def line_fp(s):
    """The four words of a line's fingerprint."""

    def runs(b, size):
        out = [b[i : i + size] for i in range(max(1, len(b) - size + 1))]
        return [(mixed(int.from_bytes(g, "little") ^ len(g) << 56 ^ 0x9E3779B97F4A7C15), 1) for g in out]

    w = s.encode().split(b" ")
    if len(w) < 8:
        parts = runs(s.encode(), 3)
    else:
        parts = [y for x in w for y in ([(word_hash(x), 1 + (len(x) > 3))] if len(x) <= 24 else runs(x, 5))]
    out, parts = [], dict(parts).items()
    for k in range(4):
        h = [(mixed(x + (k + 1) * 0xD1B54A32D192ED03 & MASK), n) for x, n in parts]
        out.append(sum(1 << j for j in range(64) if 2 * sum(n for x, n in h if x >> j & 1) > sum(n for _, n in h)))
    return tuple(out)


def line_blocks(fp):
    """The 20 blocks of 18 bits; bits are counted as they lie in bytes, from the highest of each."""
    data = b"".join(x.to_bytes(8, "little") for x in fp)
    bit = [data[i // 8] >> (7 - i % 8) & 1 for i in range(256)]
    return [tuple(bit[(1, 37)[t // 14] * (18 * (t % 14) + i) % 256] for i in range(18)) for t in range(20)]


def alike(a, b):
    return abs(len(a) - len(b)) <= int(0.2 * max(len(a), len(b)) + 1e-9) and lines.alike(a, b, 0.8)


def apart(f, g):
    """How many of the first 96 bits differ."""
    return (f[0] ^ g[0]).bit_count() + ((f[1] ^ g[1]) & 0xFFFFFFFF).bit_count()


def brute_lines(docs):
    """Line numbers that each (doc_id, text) loses."""
    first, order = {}, sorted(docs, key=lambda d: d[0])
    where = []
    for i, t in order:
        for n, line in enumerate((t or "").split("\n")):
            if p := plain(line):
                first.setdefault(p, (i, n))
                where.append((i, n, p))
    texts = list(first)
    fps = [line_fp(t) for t in texts]
    met, table = set(), {}
    for i, f in enumerate(fps):
        for t, block in enumerate(line_blocks(f)):
            table.setdefault((t, block), []).append(i)
    for v in table.values():
        met |= set(combinations(v, 2))
    links = [(i, j) for i, j in met if apart(fps[i], fps[j]) <= 20 and alike(texts[i], texts[j])]
    group = dict(zip(texts, classes(len(texts), links)))
    keep = {}
    for t, g in group.items():
        keep[g] = min(keep.get(g, (10**9, 0)), first[t])
    gone = {i: [] for i, _ in docs}
    for i, n, p in where:
        if keep[group[p]] != (i, n):
            gone[i].append(n)
    return gone, len(links)


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 40)))
        b = "".join(rng.choice(["", x, x, x, "ab"]) for x in a) if rng.random() < 0.7 else "".join(rng.choice("abé") for _ in range(rng.randint(0, 40)))
        d = distance(a, b)
        assert lines.edit_distance(a, b, 100) == d
        for most in (0, 3, d - 1, d):
            assert (lines.edit_distance(a, b, most) <= most) == (d <= most)


def test_line_fingerprints():
    texts = ["", "a", "ab", "abc", "one two three", "a b c d e f g h", "x" * 30 + " b c d e f g h", "w " * 300 + "end", "é" * 40]
    raw, off = lines.buffers(pa.array(texts, pa.string()))
    got = lines.fingerprints(raw, off)
    assert [tuple(map(int, x)) for x in got[1:]] == [line_fp(t) for t in texts[1:]]
    keys = lines.block_keys(got[1:])
    for k, t in zip(keys, texts[1:]):
        assert [int(x) for x in k] == [n << 18 | int("".join(map(str, b)), 2) for n, b in enumerate(line_blocks(line_fp(t)))]


def test_line_recall(spark):
    """Of the pairs of lines that are alike in edits, whatever their fingerprints are, nine of ten are in one group."""
    docs = [(d.doc_id, d.text) for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts = sorted({p for _, t in docs for x in (t or "").split("\n") if (p := plain(x))})
    shared = {}
    for i, t in enumerate(texts):
        w = t.split(" ")
        for g in {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))}:
            shared.setdefault(g, []).append(i)
    pairs = {p for v in shared.values() if len(v) < 60 for p in combinations(v, 2)}
    pairs = [(i, j) for i, j in pairs if alike(texts[i], texts[j])]
    raw, off = lines.buffers(pa.array(texts, pa.string()))
    fps = lines.fingerprints(raw, off)
    keys = lines.block_keys(fps)
    met = [(i, j) for i, j in pairs if (keys[i] == keys[j]).any() and apart(fps[i].tolist(), fps[j].tolist()) <= 20]
    group = classes(len(texts), met)
    print(len(pairs), len(met) / len(pairs), sum(group[i] == group[j] for i, j in pairs) / len(pairs))
    assert len(pairs) > 200 and len(met) >= 0.85 * len(pairs)
    assert sum(group[i] == group[j] for i, j in pairs) >= 0.9 * len(pairs)


def test_lines_of_tables(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want, _ = brute_lines(docs)
    got = lines.dedup_lines(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    assert {r.doc_id: list(r.removed) for r in got} == want
    texts = dict(docs)
    for r in got:
        assert r.text == "\n".join(x for n, x in enumerate(texts[r.doc_id].split("\n")) if n not in want[r.doc_id])


@pytest.mark.parametrize("rows", [4096, 6])
def test_fuzzy_lines(spark, rows, monkeypatch):
    monkeypatch.setattr(buckets, "BUCKET_ROWS", rows)
    monkeypatch.setattr(lines, "FULL", rows)
    monkeypatch.setattr(lines, "MAX_COPIED", 500_000 if rows == 4096 else 0)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(12)]
    docs = []
    for i in range(60):
        out = []
        for _ in range(4):
            w = rng.choice(base).split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.2:  # the same trigrams for the most part, in another order
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            out.append(" ".join(w))
        docs.append((i, "\n".join([*out, "--", "Page %d" % i])))
    want, links = brute_lines(docs)
    assert links > 30
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: list(r.removed) for r in got} == want


def sellers(item, text):
    row = np.zeros(len(text) + 1, np.int64)
    step = np.arange(len(text) + 1)
    for c in item:
        new = np.r_[row[0] + 1, np.minimum(row[:-1] + (text != c), row[1:] + 1)]
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


def brute_leaks(texts, items, rate=0.1):
    out = []
    for i, t in enumerate(texts):
        t = np.frombuffer(plain(t).encode(), np.uint8)
        for k, x in items:
            x = np.frombuffer(plain(x).encode(), np.uint8)
            if 0 < len(x) < 8:
                d = 0 if b" " + x.tobytes() + b" " in b" " + t.tobytes() + b" " else 1
            else:
                d = sellers(x, t) if len(x) else 1
            if d <= int(rate * len(x) + 1e-9):
                out.append((i, k, d))
    return out


def test_leaks_search():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abc de ") for _ in range(n))
    items = [(k, text(rng.choice([2, 5, 9, 14, 25, 30, 80, 200]))) for k in range(20)] + [(20, "a"), (21, "b d"), (22, "...")]
    texts = [None, "", "a"]
    for _ in range(60):
        t = text(rng.randint(0, 300))
        for _ in range(rng.randint(0, 2)):
            x = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 1 + len(x) // 9)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "q."])
            at = rng.randint(0, len(t))
            t = t[:at] + "".join(x).upper() + t[at:]
        texts.append(t)
    got = decontam.Index([k for k, _ in items], [x for _, x in items], 0.1).search(pa.array(texts, pa.string()))
    want = brute_leaks(texts, items)
    assert len(want) > 20
    assert [(a, b) for a, b, _ in want] == list(zip(got[0].tolist(), got[1].tolist()))
    assert [d for *_, d in want] == got[2].tolist()


def test_leaks_of_tables(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(80)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = docs.collect()
    want = {}
    for i, k, _ in brute_leaks([r.text for r in rows], [(b.item_id, b.text) for b in bench.collect()]):
        want.setdefault(rows[i].doc_id, []).append(k)
    for size in (decontam.BLOCK_BYTES, 4000):  # in one pass and in several
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = decontam.leaks(docs, bench).collect()
        assert {r.doc_id: list(r["items"]) for r in got if r.contaminated} == want and len(got) == len(rows)
        assert decontam.drop_contaminated(docs, bench).count() == len(rows) - len(want)


def test_line_tables_in_passes(spark, monkeypatch):
    """The entries of a pass are those of five tables; the passes link what a single one over all tables links."""
    rng = np.random.default_rng(15)
    base = rng.integers(0, 2**64, (40, 4), dtype=np.uint64)
    sketch = np.zeros(400, lines.SKETCH)
    sketch["fp"] = np.repeat(base, 10, axis=0) ^ (np.uint64(1) << rng.integers(0, 64, (400, 4), dtype=np.uint64))
    rows = spark.createDataFrame([(i, bytearray(sketch[i].tobytes())) for i in range(400)], "id bigint, sketch binary")
    keys = lines.block_keys(sketch["fp"])
    assert (lines.block_keys(sketch["fp"], range(5, 10)) == keys[:, 5:10]).all()
    linked = lambda: lines.connected_components(lines.candidates(rows))
    whole = sorted(linked().collect())
    seen, write = [], lines.materialize
    monkeypatch.setattr(lines, "materialize", lambda df, label: (seen.append(label), write(df, label))[1])
    monkeypatch.setattr(lines, "ONE_PASS", 100)
    assert sorted(linked().collect()) == whole and len({r.root for r in whole}) == 40
    assert seen.count("links") == 4
