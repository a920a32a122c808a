"""Nulls, empty and very long texts, ties and repeated rows, empty tables and clashing column names, for every operator."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import brown, chat, decontam, jaccard, lines, pieces, registry, repetition, simhash, toxicity, urlfilter, warc

LONG = "lorem ipsum dolor sit amet consectetur " * 8000
TEXTS = [(1, "one two three four five"), (1, "one two three four five"), (2, None), (3, ""), (4, " \n\t\n"), (None, "one two three four five"), (None, None), (5, LONG), (6, "é" * 3000), (7, "x"), (8, "a\nb\n\na\n"), (2, "other text under the same id")]
#: Names that operators use inside or return.
CLASH = ["fp", "key", "row_key", "score", "token_ids", "items", "removed", "n_lines", "probe", "held_out", "fingerprint", "component_id", "labelled", "toxic"]


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    return out.select("*", *(F.lit("clash").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def ids(rows, c="doc_id"):
    return sorted((r[c] is not None, r[c]) for r in rows)


def all_ids():
    return sorted((i is not None, i) for i, _ in TEXTS)


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(0, "one two three four five"), (1, None), (None, "lorem ipsum dolor"), (2, ""), (3, "lorem ipsum dolor sit amet"), (3, "lorem ipsum dolor sit amet")], "item_id bigint, text string").withColumn("items", F.lit(1))
    got = decontam.leaks(docs, bench).collect()
    assert ids(got) == all_ids()
    assert {r.doc_id: list(r["items"]) for r in got if r.contaminated} == {1: [0], None: [0], 5: [None, 3]}
    assert decontam.drop_contaminated(docs, bench).columns == docs.columns
    assert decontam.leaks(none, bench).count() == 0
    assert not any(r.contaminated for r in decontam.leaks(docs, bench.limit(0)).collect())
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == len(TEXTS)


def test_line_dedup(docs, none):
    got = lines.dedup_lines(docs).collect()
    assert ids(got) == all_ids()
    by = {(r.doc_id, r.n_lines): r for r in got}
    assert by[8, 5].text == "a\nb\n\n"  # the second a goes, blank lines stay
    assert by[None, 1].text == "one two three four five" and by[1, 1].text == ""  # rows without an id come first
    assert by[2, 0].text is None and list(by[2, 0].removed) == []
    assert lines.dedup_lines(none).count() == 0


def test_sentencepiece(docs, none):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=registry.MODEL_PATH)
    got = pieces.with_tokens(docs, registry.MODEL_PATH).collect()
    want = sorted(((i is not None, i), sp.encode(t or ""), hashlib.md5((t or "").encode()).hexdigest()) for i, t in TEXTS)
    assert sorted(((r.doc_id is not None, r.doc_id), list(r.token_ids), r.decoded_md5) for r in got) == want
    assert pieces.with_tokens(none, registry.MODEL_PATH).count() == 0


def test_sentencepiece_long():
    """Long texts without spaces, and pieces of over 16 bytes, as the library encodes them, in time."""
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=registry.MODEL_PATH)
    rng, model = random.Random(10), pieces.load(registry.MODEL_PATH)
    long = [p.decode() for i, p in enumerate(model.pieces[: model.n]) if len(p) > 16 and model.usable[i]]
    assert long
    texts = [base64.b64encode(rng.randbytes(150_000)).decode(), "a" * 8000, "=" * 8000, "the" * 3000, "ab" * 3000 + "é" * 3000, "".join(rng.choice("etaoin") for _ in range(20_000)), "".join(long[:200]), " ".join(long), *long[:300], *(x[:-1] for x in long[:300])]
    began = time.time()
    got, off = pieces.encode(model, pa.array(texts, pa.string()))
    assert time.time() - began < 40
    for k, t in enumerate(texts):
        assert got[off[k] : off[k + 1]].tolist() == sp.encode(t), t[:40]
    assert pieces.decode(model, got, off) == texts


def test_sentencepiece_against_library():
    import random

    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=registry.MODEL_PATH)
    rng, model = random.Random(9), pieces.load(registry.MODEL_PATH)
    texts = ["  a b ", "a\r\n\tb\x00", "x▁y", " " * 50, "aaaaaaaaaaaaaaaaaaaa", "日本語 中文 한국어 русский العربية", "🏳️‍🌈", "<s></s><0x0A>", None]
    texts += ["".join(rng.choice("abcdefgh  iot.,\nérst==") for _ in range(rng.randint(1, 80))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x17F), rng.randint(0x400, 0x45F), rng.randint(0x4E00, 0x9FFF), rng.randint(0x1F600, 0x1F64F)])) for _ in range(rng.randint(1, 60))) for _ in range(800)]
    got, off = pieces.encode(model, pa.array(texts, pa.string()))
    assert [got[s:e].tolist() for s, e in zip(off[:-1], off[1:])] == [sp.encode(t or "") for t in texts]
    assert pieces.decode(model, got, off) == [(t or "").replace("▁", " ") for t in texts]


def brute_repetition(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", t or "")

    def covered(k):
        n = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        return len({i + j for i in range(len(w) - k + 1) if n[tuple(w[i : i + k])] > 1 for j in range(k)})

    longest = 0
    for k in range(1, len(w)):
        if max(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)).values()) < 2:
            break
        longest = k
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, covered(8), covered(4), longest if longest >= 4 else 0


def test_repetition_brute():
    import random

    rng, names = random.Random(1), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
    for _ in range(40):
        texts = []
        for _ in range(rng.randint(1, 9)):
            v = rng.choice([2, 5, 60])
            texts.append(None if rng.random() < 0.1 else "".join(rng.choice(["a", "é", "b#", "c|"]) * rng.randint(1, 1 + v // 3) + rng.choice([" ", "\n", " \n", "\n\n", "\t"]) for _ in range(rng.choice([0, 1, 3, 30, 120]))))
        got = repetition.measures(pa.array(texts, pa.string()))
        assert [tuple(int(got[c][i]) for c in names) for i in range(len(texts))] == [brute_repetition(t) for t in texts]


def test_repetition(docs, none):
    got = repetition.repetition(docs).collect()
    assert ids(got) == all_ids()
    assert {r.doc_id for r in got if not r.base_failed} == set()
    assert next(r for r in got if r.doc_id == 5).longest_repeat == 40000 * 6 // 5 - 6
    assert repetition.repetition(none).count() == 0
    assert repetition.measures(pa.array(["abcdabcd"]), min_repeat=3, unit="char")["covered_words"].tolist() == [8]


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert ids(got) == all_ids()
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {2}
    assert {r.component_id for r in got if r.doc_id in (1, None) and r.fingerprint != "0" * 16} == {1}
    assert simhash.near_duplicates(none).count() == 0
    left = jaccard.drop_similar(docs)
    assert left.columns == docs.columns and left.count() == len(TEXTS) - 2
    alone = simhash.near_duplicates(docs.where("doc_id is null and text is null")).collect()
    assert [(r.doc_id, r.component_id) for r in alone] == [(None, None)]


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(1, None), (None, 1), (3, 0)], "doc_id bigint, toxic int").withColumn("text", F.lit("clash"))
    got = toxicity.score(docs, labels).collect()
    assert ids(got) == all_ids() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.doc_id for r in got if r.held_out} == {i for i, _ in TEXTS if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).count() == len(TEXTS)
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = sum(r.predicted == r.toxic for r in rows)
    assert good >= 0.9 * len(rows)
    clean, toxic = [r.score for r in rows if not r.toxic], [r.score for r in rows if r.toxic]
    assert sum(toxic) / len(toxic) > 3 * sum(clean) / len(clean)
    model = toxicity.language_model(docs)
    hidden = {"1d10t": "idiot", "m0r0n": "moron", "s.c.u.m": "scum", "looooser": "loser", "p4thetic": "pathetic", "the": "the"}
    assert {k: toxicity.restore(k, model) for k in hidden} == hidden


def test_brown(spark, docs, none):
    got = brown.score(docs).collect()
    assert ids(got) == all_ids() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id == 3} == {1}
    assert brown.score(none).count() == 0
    held = docs.where("doc_id = 2")  # crc32 of 2 may or may not hold it out: both ways give scores
    assert brown.score(held).count() == 2
    one = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2][0]
    r = brown.score(spark.createDataFrame([(one, "a b")], "doc_id bigint, text string")).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0


def test_brown_brute(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in brown.score(rows).collect()}
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), " end"]
    c, texts = Counter(), {r.doc_id: r.text for r in rows.collect()}
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(base)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # classes help


@pytest.mark.parametrize("most", [2000, 3])
def test_brown_score(spark, most):
    """Every word's class, the transitions and the scores, by plain counting; the classes of the clustered words are exchange()'s."""
    import numpy as np

    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(30)]
    texts = {i: None if i == 3 else " ".join(rng.choice(words[: rng.randint(2, 30)]) for _ in range(rng.randint(0, 25))) for i in range(60)}
    texts[5] = (texts[5] or "") + " never-seen"
    is_held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    got = {r.doc_id: r for r in brown.score(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3), most=most, classes=4).collect()}
    split = {i: (t or "").split() for i, t in texts.items()}
    train = [w for i, w in split.items() if not is_held[i]]
    c = Counter(x for w in train for x in w)
    often = sorted(c, key=lambda x: (-c[x], x))[:most]
    ident = {x: k + 2 for k, x in enumerate(often)}
    seqs = [[1, *(ident.get(x, 0) for x in w), 1] for w in train]
    pairs = Counter((x, y) for s in seqs for x, y in zip(s, s[1:]))
    a, b, n = (np.array(x) for x in zip(*[(*p, k) for p, k in sorted(pairs.items())]))
    cls = brown.exchange(a, b, n, len(often) + 2, 4)

    def smoothed(sequences):
        table = np.zeros((6, 6))
        for s in sequences:
            for x, y in zip(s, s[1:]):
                table[x, y] += 1
        return np.log10((table + 0.1) / (table.sum(1, keepdims=True) + 0.6))

    rough = smoothed([[cls[x] for x in s] for s in seqs])
    of = {x: int(cls[k]) for x, k in ident.items()}
    for x in set(c) - set(of):
        fit = np.zeros(4)
        for w, s in zip(train, seqs):
            for k, y in enumerate(w):
                if y == x:
                    fit += [rough[cls[s[k]], j] + rough[j, cls[s[k + 2]]] for j in range(4)]
        of[x] = int(np.argmax(np.round(fit, 9)))
    total = Counter()
    for x, k in of.items():
        total[k] += c[x]
    path = lambda w: [5, *(of.get(x, 4) for x in w), 5]
    last = smoothed([path(w) for w in train])
    for i, w in split.items():
        s = path(w)
        want = sum(last[x, y] for x, y in zip(s, s[1:])) + sum(math.log10(c[x] / total[of[x]]) for x in w if x in of)
        assert got[i].score == pytest.approx(want) and got[i].perplexity == pytest.approx(10 ** (-want / (len(w) + 1)))
        assert got[i].held_out == is_held[i] and got[i].n_known == sum(x in c for x in w) + 1


@pytest.mark.parametrize("seed", range(12))
def test_exchange(seed):
    """No single move of a word raises the likelihood of the classes that exchange() ends with."""
    import numpy as np

    rng, size, classes = np.random.default_rng(seed), 14, 3 + 4 * (seed % 3)
    pairs = {(int(x), int(y)) for x, y in rng.integers(0, size, (90, 2))}
    a, b = (np.array(x) for x in zip(*sorted(pairs)))
    n = rng.integers(1, 30, len(a)) * (1 + 9 * ((a * b + seed) % 4 == 0))

    def likelihood(cls):
        table = np.zeros((classes + 2, classes + 2))
        np.add.at(table, (cls[a], cls[b]), n)
        f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return f(table.ravel()) - f(table.sum(0)) - f(table.sum(1))

    first = np.r_[classes, classes + 1, np.arange(size - 2) % classes]
    cls = brown.exchange(a, b, n, size, classes)
    best = likelihood(cls)
    assert best >= likelihood(first)
    for w in range(2, size):
        for c in range(classes):
            other = cls.copy()
            other[w] = c
            assert likelihood(other) <= best + 1e-6


URLS = ["http://a.org/x", "https://WWW.Example.org/es/1?q#f", "http://example.org/en/123", "http://b.com/fr/", "http://b.com/de/1", None, "", "no scheme", "http://", "http://x.net", "http://x.net/", "http://www.x.net", "ftp://x.net?q/", "http://org/", "http://a.org", "http://notorg/"]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[1])], "page_id bigint, url string").withColumn("verdict", F.lit("clash")).withColumn("key", F.lit(1))
    listed = spark.createDataFrame([("x.net",), ("x.net",), ("",), (None,)], "canonical string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, listed, registry.URL_RULES).collect() if r.page_id is not None}
    assert got[0] == ("a.org", "/x", "org/", "allow")
    assert got[1] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/123", "example.org/en/1", "block")
    assert got[3] == ("b.com", "/fr/", "com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    for i in (5, 6, 7, 8):
        assert got[i] == ("", "", None, "allow")
    assert [got[i][3] for i in (9, 10, 11, 12)] == ["block"] * 4
    assert got[13][2] == "org/" and got[14][2] is None and got[15][2] is None
    assert urlfilter.filter_urls(pages, listed, []).count() == len(URLS) + 2
    assert urlfilter.filter_urls(pages.limit(0), listed, registry.URL_RULES).count() == 0
    assert urlfilter.filter_urls(pages, listed.limit(0), registry.URL_RULES).count() == len(URLS) + 2


def test_bloom(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = urlfilter.blocked_bloom(keys, 63)
    others = spark.range(20000).select(F.concat(F.lit("no"), "id").alias("key"))
    assert urlfilter.maybe_in(keys, bloom, 63).count() == 2000
    assert urlfilter.maybe_in(others, bloom, 63).count() < 400


def test_warc(spark, monkeypatch):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "u4", ""), (5, "u\n5", "other é"), (6, "u6", "x" * 300_000), (None, "u", "same"), (2, "u2", "same"), (7, "u7", "\x1f\x8b\x08 WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha", F.lit("clash"))
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    last = {"same": 2, "": 4}
    want = sorted((i or 0, len((t or "").encode()), sha(t), "response" if last.get(t or "", i) == i else "revisit", None if last.get(t or "", i) == i else last[t or ""]) for i, _, t in rows)
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(pages, min_bytes=10**6).collect()} == {"response"}


def test_warc_splits(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    warc.write_warc(pages.coalesce(1), f"file://{tmp_path}/w")
    whole = sorted(map(tuple, warc.read_warc(spark, f"file://{tmp_path}/w").drop("payload").collect()))
    for split in (777, 10_000):
        assert sorted(map(tuple, warc.read_warc(spark, f"file://{tmp_path}/w", split).drop("payload").collect())) == whole
    import gzip

    name = next((tmp_path / "w").glob("*.warc.gz"))
    assert gzip.decompress(name.read_bytes()).count(b"WARC/1.1\r\n") == len(whole) == pages.count()


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b<\\s> \\", "<|im_start|>user\nx<|im_end|>\n", None, "", "é" * 1000, "<<SYS>><</SYS>><<s>", "\\\\</s>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, "tool\nx", "t"), (2, 0, "tool\nx", "t"), (2, None, None, "n"), (None, 1, "assistant", "z"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a")]
    log = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit("clash"))
    out = {r.conv_id: r for r in chat.format_conversations(log).collect()}
    assert chat.parse(out[1].formatted) == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts)]
    assert chat.parse(out[2].formatted) == [("", "n"), ("tool\nx", "t"), ("tool\nx", "t")]
    assert [t for _, t in chat.parse(out[3].formatted)] == ["a", "b"] and chat.parse(out[None].formatted) == [("assistant", "z")]
    kept = [chat.unescape(out[1].formatted[s["start"] : s["start"] + s["length"]]) for s in out[1].loss]
    assert kept == [t or "" for t in texts[1::2]]
    bare = out[1].formatted.replace(chat.START, "").replace(chat.END, "")
    assert not any(c in bare for c in chat.CONTROL)
    assert chat.format_conversations(log.limit(0)).count() == 0
    assert chat.digests(chat.format_conversations(log)).count() == 4


def test_fold(spark):
    log = [(1, 0, 1, 0, "open", 0, "user"), (1, 0, 1, 3, "delta", 0, "lo"), (1, 0, 1, 2, "delta", 0, "hel"), (1, 0, 1, 4, "edit", 1, "i"), (1, 0, 1, 5, "what", 0, "?"), (1, 1, 1, 1, "delta", 0, "x"), (1, 1, 1, 2, "regenerate", 0, None), (1, 1, 1, 3, "delta", 0, "y")]
    got = chat.fold_events(spark.createDataFrame(log, "conv_id bigint, turn bigint, n int, seq int, kind string, at int, text string")).collect()
    assert sorted((r.turn, r.role, r.text) for r in got) == [(0, "user", "hi"), (1, "", "y")]


def test_chat_log(spark):
    """Edits, deltas after edits and regenerations in any order, against a fold event by event."""
    rng = random.Random(9)
    events, want = [], {}
    for c in range(40):
        text, role = "", ""
        for seq in range(rng.randint(0, 30)):
            kind = rng.choice(["open", "delta", "delta", "delta", "edit", "regenerate", "what"])
            at, said = rng.randint(0, 12), rng.choice([None, "ab", "c", "déf"])
            events.append((c, 0, 1, seq, kind, at, said))
            said = said or ""
            text = text + said if kind == "delta" else text[:at] + said if kind == "edit" else "" if kind == "regenerate" else text
            role = said if kind == "open" else role
            want[c] = (role, text)
    rng.shuffle(events)
    log = spark.createDataFrame(events, "conv_id bigint, turn bigint, n int, seq int, kind string, at int, text string")
    assert {r.conv_id: (r.role, r.text) for r in chat.fold_events(log).collect()} == want


def test_long_chats(spark):
    """A message of many deltas and a conversation of many turns take time in proportion."""
    began = time.time()
    text = "word </s> \\ é " * 200_000
    rows = spark.createDataFrame([(1, 0, "assistant", text)] + [(2, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(30_000)], "conv_id bigint, turn bigint, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(rows).collect()}
    assert chat.parse(out[1].formatted) == [("assistant", text)]
    assert chat.parse(out[2].formatted) == [("assistant" if i % 2 else "user", f"turn {i}") for i in range(30_000)]
    assert [chat.unescape(out[2].formatted[s["start"] : s["start"] + s["length"]]) for s in out[2].loss] == [f"turn {i}" for i in range(1, 30_000, 2)]
    assert time.time() - began < 30
