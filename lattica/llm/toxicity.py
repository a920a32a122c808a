"""Toxicity: obfuscated words are restored by Viterbi decoding under a character language model, then a text is scored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import LOWER, SLICE_BYTES, arrow_map, buffers, materialize, mix, sliced, words
from lattica.llm.components import connected_components
from lattica.llm.simhash import shingles

#: What a character may stand for (fixed values): leetspeak.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
#: Characters that may be put between letters (fixed values).
BETWEEN = ".-_*~'`^:,;/\\"
#: Log10 costs of the channel: a leet character, one put between letters, a letter said again, and a character that stays as it is
#: though it is no letter.
LEET_COST, BETWEEN_COST, AGAIN_COST, OTHER_COST = -0.3, -0.2, -0.4, -2.5
#: Symbols of the language model: the edge of a word, a to z, any other letter. It looks at three symbols before.
EDGE, OTHER, SYMBOLS, ORDER = 0, 27, 28, 4
#: The classifier is fitted on this many labelled rows at most, those whose doc_id has the least hash.
MAX_TRAIN = 20_000
#: Features of the lexicon: in MIN_DOCS toxic texts or more, most texts that have it toxic, with this log-likelihood ratio at least.
MIN_DOCS, MIN_G2, MAX_LEXICON = 4, 18.0, 50_000
#: Bands of three hashes by which near copies among the labelled rows are found.
BANDS = 10

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = OTHER
_LETTER = _SYMBOL > 0
_ODD = np.zeros(256, dtype=bool)
_ODD[[ord(c) for c in "0134567890@$!|+(" + BETWEEN]] = True


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER if ord(c) > 127 else EDGE


def trimmed(vocab: pa.Array) -> pa.Array:
    """Words without the punctuation around them, and without runs of three or more signs at their end."""
    vocab = pc.replace_substring_regex(vocab.cast(pa.string()), r"[#*$%&|<>]{3,}[.,;:!?]*$", "")
    return pc.utf8_rtrim(pc.utf8_ltrim(vocab, ".,;:?\"'()[]{}<>*#%&~-_=/\\`^"), ".,;:!?\"')]}<>*#%&~-_=/\\`^|")


def language_model(docs: DataFrame) -> np.ndarray:
    """log10 P(symbol | three before) as an array of SYMBOLS ** 4, from the words of all whole texts (column text). Words with
    digits or signs inside are left out. What is gathered has SYMBOLS ** 4 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 2 * SLICE_BYTES):
            raw, off = buffers(b.column("text"))
            ids, vocab = words(LOWER[raw] if len(raw) else raw, off).encoded()
            times = np.bincount(ids, minlength=len(vocab))
            data, at = buffers(trimmed(vocab))
            size = np.diff(at)
            fine = np.ones(len(vocab), bool)
            fine[np.searchsorted(at, np.flatnonzero(~_LETTER[data]), "right") - 1] = False
            # three edges, the word, an edge
            start = at[:-1] + 4 * np.arange(len(vocab)) + 3
            seq = np.zeros(len(data) + 4 * len(vocab), np.int64)
            seq[np.arange(len(data)) + np.repeat(start - at[:-1], size)] = _SYMBOL[data]
            owner = np.repeat(np.arange(len(vocab)), size + 4)
            code = np.zeros(len(seq), np.int64)
            for k in range(ORDER):
                code[ORDER - 1 :] = code[ORDER - 1 :] * SYMBOLS + seq[k : len(seq) - ORDER + 1 + k]
            real = np.ones(len(seq), bool)
            real[(start[:, None] + np.array([-3, -2, -1])).ravel()] = False
            real &= (fine & (size > 0))[owner]
            n = np.bincount(code[real], weights=times[owner[real]], minlength=SYMBOLS**ORDER)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some].astype(np.int64))], ["code", "n"])

    got = docs.select("text").transform(arrow_map, run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**ORDER)
    counts[got["code"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    counts = counts.reshape((SYMBOLS,) * ORDER)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for k in range(ORDER - 1, -1, -1):  # each order is backed by the one below
        c = counts.sum(axis=tuple(range(k)))
        p = (c + 5 * p) / (c.sum(-1, keepdims=True) + 5)
    return np.log10(p).ravel()


def restore(word: str, model: np.ndarray, spaced: bool = False) -> str:
    """The most probable plain word behind a lower-case word: each character stands for itself, for a letter that it looks like,
    for nothing (put between letters), or for the same letter said again. With `spaced`, a word may end before any character, and
    what is returned are words with spaces between."""
    states: dict[tuple[int, int, int], tuple[float, str]] = {(EDGE, EDGE, EDGE): (0.0, "")}
    back: list[tuple] = []
    for i, c in enumerate(word):
        options = []
        if c.isalpha():
            options.append((c, 0.0))
        else:
            options += [(x, LEET_COST) for x in LEET.get(c, "")]
            if not options and c not in BETWEEN:
                options.append((c, OTHER_COST))
            if c in BETWEEN:
                options.append(("", BETWEEN_COST))
        again = i > 0 and word[i - 1] == c
        if spaced and i:  # the words that end here all go on from one state
            ends = [(cost + model[((s[0] * SYMBOLS + s[1]) * SYMBOLS + s[2]) * SYMBOLS + EDGE], s, node) for s, (cost, node) in states.items() if s[2] != EDGE]
            if ends:
                cost, _, node = max(ends, key=lambda x: x[:2])
                states = {**states, (EDGE, EDGE, EDGE): (cost, (node, " "))}
        after: dict[tuple[int, int, int], tuple] = {}
        for state, (cost, node) in states.items():
            for x, price in [*options, *([("", AGAIN_COST)] if again else [])]:
                if x:
                    s = symbol(x)
                    to = (state[1], state[2], s)
                    now = (cost + price + (model[((state[0] * SYMBOLS + state[1]) * SYMBOLS + state[2]) * SYMBOLS + s] if s else 0.0), (node, x))
                else:
                    to, now = state, (cost + price, node)
                if to not in after or now[0] > after[to][0]:
                    after[to] = now
        states = after
    edge = lambda s: model[((s[0] * SYMBOLS + s[1]) * SYMBOLS + s[2]) * SYMBOLS + EDGE]
    node = max(states.items(), key=lambda x: (x[1][0] + edge(x[0]), x[0]))[1][1]
    while node:
        node, x = node
        back.append(x)
    return "".join(reversed(back))


def suspicious(vocab: pa.Array) -> np.ndarray:
    """Which words have another reading: a letter, and a leet or separating character or a run of three."""
    data, off = buffers(vocab)
    owner = lambda marks: np.searchsorted(off, np.flatnonzero(marks), "right") - 1
    odd, letter, run = (np.zeros(len(vocab), bool) for _ in range(3))
    if len(data):
        odd[owner(_ODD[data])] = True
        odd |= pc.match_substring(vocab.cast(pa.string()), "€").to_numpy(zero_copy_only=False)
        letter[owner(_LETTER[data])] = True
        three = np.zeros(len(data), bool)
        three[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]]
        at = np.flatnonzero(three)
        at = at[np.searchsorted(off, at, "right") == np.searchsorted(off, at - 2, "right")]
        run[np.searchsorted(off, at, "right") - 1] = True
    return letter & (odd | run)


#: Words that this worker has restored, under the language model of this name only.
_restored: dict[str, str] = {}
_restored_by: list[int] = [0]


def restored_words(given: list[str], model: np.ndarray) -> list[str]:
    """restore() of each word; what the same model has restored before is kept, for at most 200,000 words."""
    name = xxhash.xxh3_64_intdigest(np.ascontiguousarray(model))
    if _restored_by[0] != name or len(_restored) > 200_000:
        _restored.clear()
        _restored_by[0] = name
    return [_restored.get(x) or _restored.setdefault(x, restore(x, model)) for x in given]


def split_words(plain: pa.Array, ids: np.ndarray, doc: np.ndarray, known: list[str]) -> tuple[np.ndarray, list[str]]:
    """The words of `known` that two or more successive words of a text make when joined: texts and words."""
    begins = pa.array(sorted({x[:k] for x in known for k in range(1, len(x))}), pa.string())
    inside = pa.array(sorted({x[i:j] for x in known for i in range(1, len(x)) for j in range(i + 1, len(x) + 1)}), pa.string())
    whole = pa.array(known, pa.string())
    starts, goes_on = (pc.is_in(plain, value_set=v).to_numpy(zero_copy_only=False) for v in (begins, inside))
    at = np.flatnonzero(starts[ids[:-1]] & goes_on[ids[1:]] & (doc[:-1] == doc[1:]))
    so_far, owners, out = plain.take(pa.array(ids[at])), [], []
    while len(at):
        so_far = pc.binary_join_element_wise(so_far, plain.take(pa.array(ids[at + 1])), "")
        hit = pc.is_in(so_far, value_set=whole)
        owners.append(doc[at][hit.to_numpy(zero_copy_only=False)])
        out += so_far.filter(hit).to_pylist()
        at = at + 1
        last = at + 1 >= len(ids)
        after = np.minimum(at + 1, len(ids) - 1)
        more = ~last & pc.is_in(so_far, value_set=begins).to_numpy(zero_copy_only=False) & goes_on[ids[after]] & (doc[after] == doc[at])
        at, so_far = at[more], so_far.filter(pa.array(more))
    return np.concatenate(owners) if owners else np.zeros(0, np.int64), out


def restored_tokens(texts: pa.Array, model: np.ndarray, known: list[str] | None = None) -> tuple[np.ndarray, pa.Array]:
    """Pairs (text, token) without repeats, as an index and a token each: all words with their punctuation trimmed, suspicious ones
    restored, each run of three or more words of one character read as words wherever these end (and as one word, and without its
    first one or two), and the words of `known` that are split by spaces."""
    raw, off = buffers(texts)
    w = words(LOWER[raw] if len(raw) else raw, off)
    ids, vocab = w.encoded()
    size = np.diff(w.first)
    doc = np.repeat(np.arange(len(size)), size)
    plain = trimmed(vocab)
    odd = np.flatnonzero(suspicious(plain))
    extra_doc, extra = [], []
    if len(odd):
        given = plain.take(pa.array(odd)).to_pylist()
        fixed = restored_words(given, model)
        texts_of = plain.to_pandas()
        texts_of.iloc[odd] = fixed
        plain = pa.array(texts_of, pa.string())
    one = (pc.utf8_length(vocab.cast(pa.string())).to_numpy(zero_copy_only=False) == 1)[ids] if len(ids) else np.zeros(0, bool)
    if one.sum() >= 3:
        places = np.flatnonzero(one)
        cut = np.flatnonzero((np.diff(places) != 1) | (doc[places[1:]] != doc[places[:-1]])) + 1
        names = vocab.to_pylist() if len(vocab) < 10_000 else None
        for run in np.split(places, cut):
            if len(run) < 3:
                continue
            chars = [names[i] if names else vocab[int(i)].as_py() for i in ids[run]]
            for skip in range(min(3, len(run) - 2)):
                extra_doc.append(doc[run[0]])
                extra.append(restore("".join(chars[skip:]), model))
            found = restore("".join(chars), model, spaced=True).split(" ")
            extra_doc += [doc[run[0]]] * len(found)
            extra += found
    if known and len(ids) > 1:
        owners, found = split_words(plain.cast(pa.string()), ids, doc, known)
        extra_doc += owners.tolist()
        extra += found
    token, names = plain.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), plain.dictionary_encode().dictionary
    pairs = np.unique(doc * max(1, len(names)) + token[ids]) if len(ids) else np.zeros(0, np.int64)
    owner, own = pairs // max(1, len(names)), pairs % max(1, len(names))
    if extra:
        both = pa.concat_arrays([names.cast(pa.string()), pa.array(extra, pa.string())]).dictionary_encode()
        code, names = both.indices.to_numpy(zero_copy_only=False).astype(np.int64), both.dictionary
        pairs = np.unique(np.r_[owner, extra_doc].astype(np.int64) * len(names) + code[np.r_[own, len(code) - len(extra) + np.arange(len(extra))]])
        owner, own = pairs // len(names), pairs % len(names)
    return np.stack([owner, own]), names.cast(pa.string())


def features(names: pa.Array) -> list[pa.Array]:
    """The features of each token: itself, and its first four, five and six characters if it is longer."""
    size = pc.utf8_length(names)
    out = [pc.if_else(pc.greater(size, 1), pc.binary_join_element_wise("w", names, ":"), None)]
    for k in (4, 5, 6):
        out.append(pc.if_else(pc.greater(size, k), pc.binary_join_element_wise(str(k), pc.utf8_slice_codeunits(names, 0, k), ":"), None))
    return out


class Model:
    """A lexicon of features with weights, and the two coefficients of the logistic score of a text's evidence."""

    def __init__(self, language: np.ndarray, lexicon: list[str], weights: np.ndarray, bias: float = -2.0, slope: float = 1.0):
        self.language, self.lexicon, self.weights, self.bias, self.slope = language, lexicon, weights, bias, slope

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """The sum over a text's different tokens of the weight of each one's strongest feature."""
        (owner, token), names = restored_tokens(texts, self.language, [x[2:] for x in self.lexicon if x.startswith("w:")])
        out = np.zeros(len(texts))
        if not len(owner) or not self.lexicon:
            return out
        known = pa.array(self.lexicon, pa.string())
        best = np.zeros(len(names))
        padded = np.r_[self.weights, 0.0]
        for f in features(names):
            best = np.maximum(best, padded[pc.fill_null(pc.index_in(f, value_set=known), len(self.lexicon)).to_numpy(zero_copy_only=False)])
        w = best[token]
        hit = w > 0
        return np.bincount(owner[hit], weights=w[hit], minlength=len(texts)) if hit.any() else out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + self.slope * np.minimum(self.evidence(texts), 20.0))))


def learnt(doc_id, mod: int = 4, rest: int = 2):
    """Whether labels of a row may be learnt: crc32 of its id as text has another remainder than `rest`."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)) != rest


def weighted(rows: DataFrame) -> DataFrame:
    """rows (labelled, text, toxic) with `weight`: near copies of one label count as one text together, so that the words of a text
    that was copied often are no evidence. Near copies share three of three hashes in one of BANDS bands: nearly all do whose sets of
    five-word shingles have a Jaccard similarity of 0.8, and hardly any that only have a passage in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 2 * SLICE_BYTES):
            h, first = shingles(b.column("text"), 5, 42)
            some = np.flatnonzero(np.diff(first))
            ids = b.column("labelled").take(pa.array(some))
            for band in range(BANDS if len(some) else 0):
                key = np.zeros(len(some), np.uint64)
                for k in range(3 * band, 3 * band + 3):
                    key = mix(key ^ np.minimum.reduceat(mix(h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), first[some]))
                yield pa.RecordBatch.from_arrays([ids, pa.array((key ^ np.uint64(band)).view(np.int64))], ["labelled", "key"])

    keys = rows.select("labelled", "text").transform(arrow_map, run, "labelled bigint, key bigint").distinct()
    least = keys.groupBy("key").agg(F.min("labelled").alias("a")).withColumnRenamed("key", "of")
    groups = connected_components(keys.join(least, F.col("key") == F.col("of")).select("a", F.col("labelled").alias("b")))
    named = rows.join(groups, F.col("labelled") == F.col("node"), "left").withColumn("unit", F.coalesce("root", "labelled")).drop("node", "root")
    sizes = named.groupBy(F.col("unit").alias("u"), F.col("toxic").alias("t")).agg((1 / F.count("*")).alias("weight"))
    return named.join(F.broadcast(sizes), (F.col("unit") == F.col("u")) & (F.col("toxic") == F.col("t"))).select("labelled", "text", "toxic", "weight")  # a row per labelled text at most


def fit(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, max_train: int = MAX_TRAIN) -> Model:
    """Learns the language model from all texts, and the lexicon and score from at most max_train labelled rows, in which near copies
    count as one.

    docs: doc_id, text. labels: doc_id, toxic; a row without id or label teaches nothing, of several labels of one id the largest
    counts. Without labelled rows of both kinds the lexicon is empty and the score is the share of toxic labels (0.02 if none)."""
    language = language_model(docs)
    known = labels.where("doc_id is not null and toxic is not null").where(learnt(F.col("doc_id"), mod, rest)).groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("labelled"), "labelled").limit(max_train)
    rows = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).select("labelled", "text", "toxic")  # max_train rows at most
    rows = materialize(weighted(materialize(rows, "labelled")), "weighted")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 2 * SLICE_BYTES):
            (owner, token), names = restored_tokens(b.column("text"), language)
            weight = b.column("weight").to_numpy(zero_copy_only=False)
            toxic = weight * (b.column("toxic").to_numpy(zero_copy_only=False) > 0)
            for f in features(names):
                got = f.dictionary_encode()
                code = pc.fill_null(got.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[token]
                wide = len(got.dictionary)
                pairs = np.unique((owner * (wide + 1) + code)[code >= 0])
                of, text = pairs % (wide + 1), pairs // (wide + 1)
                n, p = (np.bincount(of, weights=w[text], minlength=wide).astype(np.float64) for w in (weight, toxic))
                yield pa.RecordBatch.from_arrays([got.dictionary, pa.array(n[:wide]), pa.array(p[:wide])], ["feature", "n", "p"])

    size, positive = rows.agg(F.round(F.coalesce(F.sum("weight"), F.lit(0)), 6), F.round(F.coalesce(F.sum(F.col("weight") * F.col("toxic")), F.lit(0)), 6)).first()
    if not positive or positive == size:
        share = positive / size if size else 0.02
        return Model(language, [], np.zeros(0), math.log(max(share, 0.02) / (1 - min(share, 0.98))), 0.0)
    prior = positive / size
    found = rows.transform(arrow_map, count, "feature string, n double, p double").groupBy("feature").agg(F.round(F.sum("n"), 6).alias("n"), F.round(F.sum("p"), 6).alias("p"))
    n, p = F.col("n"), F.col("p")
    g2 = 2 * (p * F.log(p / (n * prior)) + F.when(n > p, (n - p) * F.log((n - p) / (n * (1 - prior)))).otherwise(0))
    found = found.where((p >= MIN_DOCS) & (2 * p > n) & (p > n * prior)).withColumn("g2", g2).where(F.col("g2") >= MIN_G2)
    best = found.orderBy(F.desc("g2"), "feature").limit(MAX_LEXICON).collect()
    weights = np.array([math.log(((r["p"] + 0.5) / (positive + 1)) / ((r["n"] - r["p"] + 0.5) / (size - positive + 1))) for r in best])
    model = Model(language, [r["feature"] for r in best], weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 2 * SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(model.evidence(b.column("text"))), b.column("toxic"), b.column("weight")], ["x", "toxic", "weight"])

    got = rows.transform(arrow_map, measure, "x double, toxic int, weight double").toPandas()
    x, y, w = np.minimum(got["x"].to_numpy(), 20.0), got["toxic"].to_numpy(np.float64), got["weight"].to_numpy()
    order = np.lexsort((w, y, x))  # rows come in any order; sums are made in one
    x, y, w = x[order], y[order], w[order]
    coef, design = np.array([math.log(prior / (1 - prior)), 0.5]), np.stack([np.ones_like(x), x], 1)
    for _ in range(50):  # Newton's method, with a weak pull of the slope to 0
        q = 1 / (1 + np.exp(-np.clip(design @ coef, -30, 30)))
        gradient = design.T @ (w * (y - q)) - np.array([0, 0.1]) * coef
        step = np.linalg.solve(design.T @ (design * (w * q * (1 - q))[:, None]) + np.diag([1e-6, 0.1]), gradient)
        coef = coef + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    model.bias, model.slope = float(coef[0]), float(coef[1])
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 4, rest: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold) of every row's whole text.

    Null and empty texts have no evidence and the score of a text without toxic words. Rows without doc_id are scored and held_out
    is false; repeated rows are returned as they come; other columns are ignored."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = fit(own, labels, mod, rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 2 * SLICE_BYTES):
            s = model.scores(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    marked = own.withColumn("held_out", F.coalesce(~learnt(F.col("doc_id"), mod, rest), F.lit(False)))
    return marked.transform(arrow_map, run, "doc_id bigint, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score() predicts to be toxic; all columns stay."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = fit(own, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text_col, 2 * SLICE_BYTES):
            yield b.filter(pa.array(model.scores(b.column(text_col).cast(pa.string())) < threshold))

    return docs.transform(arrow_map, run, docs.schema)
