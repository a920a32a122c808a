"""Kernels against brute force: maximal repeats, restoring under two models."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import repetition, toxicity


def maximal_repeats(w, least):
    """Word sequences that stand in two places or more, with different neighbours on either side."""
    at = {}
    for i in range(len(w)):
        for j in range(i + least, len(w) + 1):
            at.setdefault(tuple(w[i:j]), []).append(i)
    left = lambda i: w[i - 1] if i else ("start", i)
    right = lambda j: w[j] if j < len(w) else ("end", j)
    return sum(len(v) > 1 and len({left(i) for i in v}) > 1 and len({right(i + len(k)) for i in v}) > 1 for k, v in at.items())


@pytest.mark.parametrize("least", [2, 4])
def test_maximal_repeats(least):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["a b c d e x a b c d e y a b c d z", None, ""]
    got = repetition.measures(pa.array(texts, pa.string()), 8, least)["n_maximal_repeats"].tolist()
    assert got == [maximal_repeats((t or "").split(), least) for t in texts]


def language(words):
    counts = np.zeros((toxicity.SYMBOLS,) * toxicity.ORDER)
    for w in words:
        seq = [0, 0, 0, *map(toxicity.symbol, w), 0]
        for k in range(len(seq) - 3):
            counts[tuple(seq[k : k + 4])] += 100
    p = np.full(toxicity.SYMBOLS, 1 / toxicity.SYMBOLS)
    for k in range(toxicity.ORDER - 1, -1, -1):
        c = counts.sum(axis=tuple(range(k)))
        p = (c + 5 * p) / (c.sum(-1, keepdims=True) + 5)
    return np.log10(p).ravel()


def paths(word):
    """Every reading of a word, with what the channel costs."""
    out = {"": 0.0}
    for i, c in enumerate(word):
        options = [(c, 0.0)] if c.isalpha() else [(x, toxicity.LEET_COST) for x in toxicity.LEET.get(c, "")]
        if not options and c not in toxicity.BETWEEN:
            options.append((c, toxicity.OTHER_COST))
        if c in toxicity.BETWEEN:
            options.append(("", toxicity.BETWEEN_COST))
        if i and word[i - 1] == c:
            options.append(("", toxicity.AGAIN_COST))
        after = {}
        for said, cost in out.items():
            for x, price in options:
                after[said + x] = max(after.get(said + x, -1e9), cost + price)
        out = after
    return out


def test_restore_is_the_best_path():
    model = language(["hit", "idiot", "seal", "hello", "tall", "hilt"] * 3)

    def total(said, cost):
        seq = [0, 0, 0, *map(toxicity.symbol, said), 0]
        return cost + sum(model[((seq[k] * 28 + seq[k + 1]) * 28 + seq[k + 2]) * 28 + seq[k + 3]] for k in range(len(seq) - 3))

    for word in ["h1t", "1d10t", "i-d.i-o.t", "hheelllo", "5e4l", "t4|l", "id!ott", "h€llo", "7a11"]:
        best = max(total(s, c) for s, c in paths(word).items())
        got = toxicity.restore(word, model)
        assert total(got, paths(word)[got]) == pytest.approx(best)


def test_two_models_in_one_worker():
    texts = pa.array(["h1t"])
    for words, want in ((["hlt", "hltx"], "hlt"), (["hit", "hits"], "hit"), (["hlt", "hltx"], "hlt")):
        _, names = toxicity.restored_tokens(texts, language(words * 9))
        assert names.to_pylist() == [want]


def test_signs_that_stand_for_letters_are_suspicious():
    assert toxicity.suspicious(pa.array(["h€llo", "hello", "h3llo", "élan", "hellllo"])).tolist() == [True, False, True, False, True]


def test_copies_count_once(spark):
    """Near copies of one label weigh one together; a text that shares only a passage weighs one by itself."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(300)], [word() for _ in range(40)]
    rows = []
    for i in range(12):
        w = list(base)
        w[rng.randrange(300)] = word()
        rows.append((i, " ".join(w), int(i < 8)))
    rows += [(100 + i, " ".join([word() for _ in range(200)] + passage), 1) for i in range(5)] + [(200, None, 0), (201, "", 0)]
    got = {r.labelled: r.weight for r in toxicity.weighted(spark.createDataFrame(rows, "labelled bigint, text string, toxic int")).collect()}
    assert got == pytest.approx({i: 1 / 8 for i in range(8)} | {i: 1 / 4 for i in range(8, 12)} | {i: 1.0 for i in (100, 101, 102, 103, 104, 200, 201)})
