"""The near-dedup stage against brute-force Jaccard similarity, without a limit of bits."""

import os
import random
import sys
from itertools import combinations

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_neardup import classes, fingerprint

import corpus_pipeline
from lattica.llm import buckets, jaccard


def shingle_set(text):
    w = text.lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept(texts):
    """The row numbers that stay, and the pairs that are alike."""
    sets = [shingle_set(t) for t in texts]
    near = [(i, j) for i, j in combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return sorted(set(classes(len(texts), near))), near


def near_dedup(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())


def drafts():
    """Texts with some words replaced, and a passage that many of them share."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = ["", " ", "one", "One"]
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120, 300]))]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 45)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w + (passage if k % 2 else [])))
    return texts


@pytest.mark.parametrize("rows", [4096, 6])
def test_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(buckets, "BUCKET_ROWS", rows)
    texts = drafts()
    want, near = kept(texts)
    far = [(i, j) for i, j in near if (fingerprint(texts[i], 5) ^ fingerprint(texts[j], 5)).bit_count() > 7]
    assert len(far) > 20  # pairs that a limit of seven bits loses
    assert near_dedup(spark, texts) == want


def test_any_order_of_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_COMMON", 50)
    texts = drafts()
    assert near_dedup(spark, texts) == kept(texts)[0]


def test_empty_and_null(spark):
    rows = [(2, "a b c d e f"), (2, "x y z"), (3, "x y z"), (None, "x y z"), (None, None), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, "x y z"), (2, "a b c d e f"), (2, "x y z"), (4, "")]


def test_equal_fingerprints(spark):
    """A repeated word makes the fingerprint, the rest of the text differs."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = ["spam " * 200 + " ".join(word() for _ in range(60)) for _ in range(12)]
    assert len({fingerprint(t, 5) for t in texts}) == 1 and kept(texts)[1] == []
    assert near_dedup(spark, [*texts, *texts]) == list(range(12))


def test_bitmaps_bound_what_differs():
    rng = np.random.default_rng(13)
    pool = rng.integers(-(2**63), 2**63, 30_000, dtype=np.int64)
    sets = [rng.choice(pool[:many], size, replace=False) for many, size in [(70, 60), (70, 66), (500, 400), (500, 480), (6000, 5000), (6000, 5900), (30_000, 9000), (30_000, 200), (1, 1)]]
    bits = jaccard.bitmaps(np.concatenate(sets), np.r_[0, np.cumsum([len(x) for x in sets])]).to_numpy(zero_copy_only=False)
    x, y = np.array(list(combinations(range(len(sets)), 2))).T
    got = jaccard.differing(bits, x, y).tolist()
    assert all(d <= len(np.setxor1d(sets[i], sets[j])) for d, i, j in zip(got, x, y))
    assert jaccard.differing(bits, x, x).tolist() == [0] * len(x)
    one = jaccard.bitmaps(np.r_[sets[4], sets[4][3:], pool[-3:]], np.array([0, 5000, 10_000])).to_numpy(zero_copy_only=False)
    assert 0 < jaccard.differing(one, np.array([0]), np.array([1]))[0] <= 6


def test_shared_passages_are_no_candidates(spark, monkeypatch):
    """Texts that only share a passage are told apart before their sets are joined."""
    rng = random.Random(14)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    texts = []
    for _ in range(30):
        passage = words(40)
        texts += [" ".join(words(100) + passage + words(200)) for _ in range(2)]
    texts.append(texts[0] + " end")
    found, settle = [], jaccard.settle

    def spy(nodes, search, verify, likely):
        found.append(search(nodes.withColumn("label", nodes.id), False).count())
        return settle(nodes, search, verify, likely)

    monkeypatch.setattr(jaccard, "settle", spy)
    assert near_dedup(spark, texts) == list(range(60))
    assert found == [1]
