"""Language-model scoring with Brown classes: exchange clustering of words, then a class bigram model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import LOWER, arrow_map, buffers, drop_shuffles, materialize, release, sliced, words

#: The most frequent words, at most so many, are clustered by exchange in one task: their bigrams are at most (MOST + 2) squared rows
#: of 24 bytes, 96 MB, however large the corpus. Every other word of the corpus is then put in the class that its own neighbours fit.
MOST, CLASSES, ALPHA = 2_000, 48, 0.1
#: Ids of the bigram table: words that are not clustered, the end of a text (also what precedes its first word), then the others.
RARE, END, FIRST = 0, 1, 2
COUNT_BYTES, BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 8 << 20, 1 << 16
#: A token's class before it is known.
UNKNOWN = 255


def held_out(doc_id, mod: int = 7, rest: int = 2):
    """Whether crc32 of the id as text has this remainder; rows without id are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def tokens(texts: pa.Array):
    raw, off = buffers(texts)
    w = words(LOWER[raw] if len(raw) else raw, off)
    ids, vocab = w.encoded()
    return w.first, ids, vocab


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all whole texts (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", COUNT_BYTES):
            _, ids, vocab = tokens(b.column("text"))
            yield pa.RecordBatch.from_arrays([vocab.cast(pa.string()), pa.array(np.bincount(ids, minlength=len(vocab)))], ["word", "n"])

    return texts.select("text").transform(arrow_map, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def clustered_ids(ids: np.ndarray, vocab: pa.Array, clustered: pa.Array) -> np.ndarray:
    """The id in the bigram table of each word of a batch."""
    if not len(vocab):
        return np.zeros(0, np.int64)
    found = pc.index_in(vocab.cast(pa.string()), value_set=clustered)
    return pc.fill_null(pc.add(found, FIRST), RARE).to_numpy(zero_copy_only=False).astype(np.int64)[ids]


def with_ends(first: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The ids of some texts, each followed by END."""
    return np.insert(own, first[1:], END)


def bigram_counts(texts: DataFrame, clustered: list[str]) -> DataFrame:
    """a, b, n: how often id b follows id a, over all whole texts."""
    known, wide = pa.array(clustered, pa.string()), len(clustered) + FIRST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", COUNT_BYTES):
            first, ids, vocab = tokens(b.column("text"))
            after = with_ends(first, clustered_ids(ids, vocab, known))
            pairs, n = np.unique(np.r_[END, after[:-1]] * wide + after, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs // wide), pa.array(pairs % wide), pa.array(n)], ["a", "b", "n"])

    return texts.select("text").transform(arrow_map, run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, size: int, classes: int = CLASSES) -> np.ndarray:
    """The class of each of `size` ids. RARE and END have classes of their own (classes and classes + 1). The other ids, in order of
    frequency, start in turn in each class; then, in sweeps until none moves, each one is put in the class in which the
    likelihood of the class bigrams, sum N(c, d) log N(c, d) - 2 sum N(c) log N(c), is greatest (the first one, in a tie). A move
    that adds less than 1e-10 of N log N doesn't count, so that rounding moves nothing and the sweeps end."""
    total = classes + 2
    cls = np.empty(size, np.int64)
    cls[:FIRST] = classes, classes + 1
    cls[FIRST:] = np.arange(size - FIRST) % classes
    n = n.astype(np.float64)
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    out_at, in_at = np.searchsorted(a[by_a], np.arange(size + 1)), np.searchsorted(b[by_b], np.arange(size + 1))
    out_to, out_n, in_from, in_n = b[by_a], n[by_a], a[by_b], n[by_b]
    table = np.bincount(cls[a] * total + cls[b], weights=n, minlength=total * total).reshape(total, total)
    each = np.arange(classes)
    least, moved = 1e-10 * max(1.0, float(_f(n.sum()))), 1
    while moved:
        moved = 0
        for w in range(FIRST, size):
            to, x = out_to[out_at[w] : out_at[w + 1]], out_n[out_at[w] : out_at[w + 1]]
            fro, y = in_from[in_at[w] : in_at[w + 1]], in_n[in_at[w] : in_at[w + 1]]
            own = x[to == w].sum()
            right = np.bincount(cls[to[to != w]], weights=x[to != w], minlength=total)
            left = np.bincount(cls[fro[fro != w]], weights=y[fro != w], minlength=total)
            c = cls[w]
            table[c] -= right
            table[:, c] -= left
            table[c, c] -= own
            rows, cols = table[:classes], table[:, :classes].T
            gain = (_f(rows + right) - _f(rows)).sum(1) + (_f(cols + left) - _f(cols)).sum(1)
            diag = table[each, each]
            gain += _f(diag + right[:classes] + left[:classes] + own) - _f(diag + right[:classes]) - _f(diag + left[:classes]) + _f(diag)
            # what comes before the word, or after it, counts in the sums wherever the word goes
            sums, also = (table.sum(1) + left)[:classes], (table.sum(0) + right)[:classes]
            gain -= _f(sums + right.sum() + own) - _f(sums) + _f(also + left.sum() + own) - _f(also)
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + least:
                best = c
            table[best] += right
            table[:, best] += left
            table[best, best] += own
            cls[w] = best
            moved += best != c
    return cls


def classes_of(bigrams: DataFrame, size: int, classes: int) -> np.ndarray:
    """exchange() in one task on an executor: the table has (MOST + 2) squared rows at most, however large the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for b in batches]
        a, b, n = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((b, a))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(exchange(a[order], b[order], n[order], size, classes))], ["id", "class"])

    rows = bigrams.select("a", "b", "n").coalesce(1).transform(arrow_map, run, "id bigint, class bigint").collect()
    cls = np.zeros(size, np.int64)
    for r in rows:
        cls[r["id"]] = r["class"]
    return cls


def class_bigrams(pairs: DataFrame, total: int) -> np.ndarray:
    """The counts (c, d, n) of class d after class c as a matrix."""
    table = np.zeros((total, total))
    for r in pairs.groupBy("c", "d").agg(F.sum("n").alias("n")).collect():  # classes squared at most
        table[r["c"], r["d"]] = r["n"]
    return table


def smoothed(table: np.ndarray) -> np.ndarray:
    """log10 of the probability of each class after each other one."""
    return np.log10((table + ALPHA) / (table.sum(1, keepdims=True) + ALPHA * len(table)))


def neighbours(texts: DataFrame, clustered: list[str], cls: np.ndarray) -> DataFrame:
    """word, near: for the words of all texts that are not clustered, the classes before and after each occurrence, two bytes each."""
    known = pa.array(clustered, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", COUNT_BYTES):
            first, ids, vocab = tokens(b.column("text"))
            mine = clustered_ids(ids, vocab, known)
            c = cls[with_ends(first, mine)].astype(np.uint8)
            at = np.flatnonzero(mine == RARE)
            place = at + np.searchsorted(first[1:], at, "right")  # in the sequence with ends
            order = np.argsort(ids[at], kind="stable")
            at, place = at[order], place[order]
            near = np.stack([np.where(place > 0, c[place - 1], cls[END]), c[place + 1]], 1).astype(np.uint8) if len(at) else np.zeros((0, 2), np.uint8)
            head = np.flatnonzero(np.r_[True, ids[at][1:] != ids[at][:-1]]) if len(at) else np.zeros(0, np.int64)
            packed = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer((np.r_[head, len(at)] * 2).astype(np.int32)), pa.py_buffer(near.tobytes())])
            yield pa.RecordBatch.from_arrays([vocab.take(pa.array(ids[at[head]])).cast(pa.string()), packed], ["word", "near"])

    return texts.select("text").transform(arrow_map, run, "word string, near binary")


def placed(near: DataFrame, transition: np.ndarray, classes: int) -> DataFrame:
    """word, class: the class that is most probable between the neighbours of all occurrences (the first one, in a tie)."""
    total = len(transition)

    def best(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.column("word").dictionary_encode()
        word, n = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(found.dictionary)
        data, off = buffers(batch.column("near").cast(pa.large_binary()).view(pa.large_string()))
        owner = np.repeat(word, np.diff(off) // 2)
        before, after = (np.bincount(owner * total + data[k::2], minlength=n * total).reshape(n, total) for k in (0, 1))
        fit = (before @ transition + after @ transition.T)[:, :classes]
        return pa.RecordBatch.from_arrays([found.dictionary, pa.array(np.argmax(np.round(fit, 9), 1).astype(np.int32))], ["word", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last word, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            words = b.column("word")
            same = pc.not_equal(words, words[b.num_rows - 1]).to_numpy(zero_copy_only=False)
            cut = int(same.sum())
            held = b.slice(cut)
            if cut:
                yield best(b.slice(0, cut))
        if held is not None:
            yield best(held)

    return near.repartition("word").sortWithinPartitions("word").transform(arrow_map, run, "word string, class int")


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
SEQUENCES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, emission double, classes binary"


def score(docs: DataFrame, mod: int = 7, rest: int = 2, most: int = MOST, classes: int = CLASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (log10 probability
    by unigrams with add-one smoothing), score (by the class bigrams) and perplexity (10 to the -score / n_tokens).

    The model learns from all rows that are not held out. Every word of theirs has a class: the `most` frequent ones by exchange, each
    other one by its neighbours. log10 p(w | v) = log10 p(class of w | class of v) + log10 p(w | its class): transitions between
    classes are counted over all tokens and smoothed by ALPHA, emissions are relative counts. A word that was never seen is a class
    of its own, to which smoothing alone leads. Null and empty texts have one token, the end. Rows without doc_id are learnt from,
    repeated rows count and are returned as often as they come, other columns are ignored, an empty table gives an empty result; if
    all rows are held out, nothing is known and the scores are those of the smoothing.

    Counts and classes of the words that are not clustered reach the texts by a join: per block of texts, each such word comes once,
    with the places where it stands. The texts' classes are then written, a byte per token."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("held_out", held_out(F.col("doc_id"), mod, rest))
    train = own.where("not held_out")
    counts = materialize(word_counts(train), "word-counts")
    n_docs = train.count()
    n_words, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_train, v_train = n_words + n_docs, vocabulary + (n_docs > 0)
    often = counts.orderBy(F.desc("n"), "word").limit(most).collect()
    clustered, freq = [r["word"] for r in often], np.array([r["n"] for r in often], np.float64)
    size, total = len(clustered) + FIRST, classes + 2
    bigrams = materialize(bigram_counts(train, clustered), "bigrams")
    cls = classes_of(bigrams, size, classes)
    maps = [F.element_at(F.lit(cls.tolist()), (F.col(c) + 1).cast("int")) for c in "ab"]
    rough = smoothed(class_bigrams(bigrams.select(maps[0].alias("c"), maps[1].alias("d"), "n"), total))
    release(bigrams)
    # the other words, each with its count and class
    near = placed(neighbours(train, clustered, cls), rough, classes)
    others = materialize(near.join(counts, "word").select("word", "n", "class"), "placed")
    release(counts)
    del near
    drop_shuffles(docs.sparkSession)
    members = np.bincount(cls[FIRST:], weights=freq, minlength=total) if len(freq) else np.zeros(total)
    for r in others.groupBy("class").agg(F.sum("n").alias("n")).collect():  # a row per class
        members[r["class"]] += r["n"]
    known = np.zeros(size)
    known[END], known[FIRST:] = n_docs, freq
    emission = np.zeros(size)
    emission[FIRST:] = np.log10(freq / members[cls[FIRST:]]) if len(freq) else 0
    norm = np.log10(n_train + v_train + 1)
    base_of = np.log10(known + 1)
    names = pa.array(clustered, pa.string())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId() << 32, 0
        for big in sliced(batches, "text", BLOCK_BYTES):
            for at in range(0, big.num_rows, BLOCK_DOCS):
                b = big.slice(at, BLOCK_DOCS)
                first, ids, vocab = tokens(b.column("text"))
                n = b.num_rows
                mine = clustered_ids(ids, vocab, names)
                seq = with_ends(first, mine)
                ends = first + np.arange(n + 1)
                rare = np.flatnonzero(seq == RARE)
                kind = np.where(seq == RARE, UNKNOWN, cls[seq]).astype(np.uint8)
                usual = np.where(seq == RARE, 0.0, base_of[seq])
                said = np.where(seq == RARE, 0.0, emission[seq])
                cum = lambda x: np.diff(np.r_[0, np.cumsum(x)][ends])
                word = ids[mine == RARE]
                order = np.argsort(word, kind="stable")
                word = word[order]
                wide = 3 + (len(seq) >= 1 << 24)  # bytes of a place; the key says which
                place = np.ascontiguousarray(rare[order].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide])
                head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
                key = (part | block) << 1 | wide - 3
                block += 1
                yield rows(len(head), key, vocab.take(pa.array(word[head])).cast(pa.string()), packed(np.r_[head, len(word)] * wide, place))
                alone = pa.array([f" {key} {i}" for i in range(n)], pa.string())  # equal to no word: it has a space
                yield rows(n, key, alone, packed(ends, kind), b.column("doc_id"), b.column("held_out"), cum(np.ones(len(seq))), cum((seq != RARE) & (known[seq] > 0)), cum(usual), cum(said))

    # a text's own figures are one column, so that the rows of words, of which there are far more, are short
    columns = {"i": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "emission": pa.float64()}
    kind_of_text = pa.struct(list(columns.items()))

    def packed(off: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(values.tobytes())])

    def rows(n: int, key: int, word: pa.Array, data: pa.Array, *meta) -> pa.RecordBatch:
        fields = [m.cast(k) if isinstance(m, pa.Array) else pa.array(m).cast(k, safe=False) for m, k in zip([np.arange(n), *meta], columns.values())] if meta else []
        text = pa.StructArray.from_arrays(fields, fields=list(kind_of_text)) if meta else pa.nulls(n, kind_of_text)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), word, data, text], ["block", "word", "data", "text"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, found = None, [], []

        def bytes_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            column = t.column("data").combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            return buffers(column.cast(pa.large_binary()).view(pa.large_string()))

        def done() -> pa.RecordBatch:
            own = pa.Table.from_batches(texts)
            t = pa.table({"data": own.column("data")} | {c: pc.struct_field(own.column("text"), c) for c in columns}).sort_by("i").combine_chunks()
            get = lambda c: t.column(c).to_numpy()
            data, off = bytes_of(t)
            kind, extra = data.copy(), np.zeros((3, len(t)))
            if found:
                f = pa.Table.from_batches(found).combine_chunks()
                refs, at = bytes_of(f)
                wide = 3 + int(now & 1)
                place = refs.reshape(-1, wide).astype(np.int64) @ (1 << 8 * np.arange(wide))
                times = np.diff(at) // wide
                n, c = f.column("n").to_numpy().astype(np.float64), f.column("class").to_numpy()
                kind[place] = np.repeat(c, times)
                doc = np.searchsorted(off, place, "right") - 1
                for k, x in enumerate((np.ones(len(n)), np.log10(n + 1), np.log10(n / members[c]))):
                    extra[k] = np.bincount(doc, weights=np.repeat(x, times), minlength=len(t))
            kind[kind == UNKNOWN] = classes
            out = [t.column(c).combine_chunks() for c in ("doc_id", "held_out", "n_tokens")]
            out += [pa.array(get("n_known") + extra[0].astype(np.int64)), pa.array(get("base") + extra[1]), pa.array(get("emission") + extra[2]), packed(off, kind)]
            return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], [x.split()[0] for x in SEQUENCES.split(", ")])

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = np.r_[0, np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, len(blocks)] if len(blocks) else [0]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if blocks[s] != now:
                    if texts:
                        yield done()
                    now, texts, found = blocks[s], [], []
                part = batch.slice(s, e - s)
                is_text = pc.is_valid(part.column("text"))
                texts.append(part.filter(is_text))
                found.append(part.filter(pc.and_(pc.invert(is_text), pc.is_valid(part.column("n")))))
        if texts:
            yield done()

    emitted = own.transform(arrow_map, emit, "block bigint, word string, data binary, text struct<i:bigint,doc_id:bigint,held_out:boolean,n_tokens:bigint,n_known:bigint,base:double,emission:double>")
    named = others.select(F.col("word").alias("w"), "n", "class")
    joined = emitted.join(named, F.col("word") == F.col("w"), "left").where("n is not null or text is not null").drop("word", "w")
    sequences = materialize(joined.repartition("block").sortWithinPartitions("block").transform(arrow_map, gather, SEQUENCES), "sequences")
    release(others)

    def classes_in(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The classes of all tokens, those before them (the end of a text precedes the next one), and each text's first token."""
        data, off = buffers(b.column("classes").cast(pa.large_binary()).view(pa.large_string()))
        now = data.astype(np.int64)
        return now, np.r_[classes + 1, now[:-1]] if len(now) else now, off

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(total * total, np.int64)
        for b in batches:
            now, before, _ = classes_in(b)
            table += np.bincount(before * total + now, minlength=total * total)
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array((some // total).astype(np.int32)), pa.array((some % total).astype(np.int32)), pa.array(table[some])], ["c", "d", "n"])

    transition = smoothed(class_bigrams(sequences.where("not held_out").select("classes").transform(arrow_map, pairs, "c int, d int, n bigint"), total))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            now, before, off = classes_in(b)
            n = np.diff(off)
            model = np.add.reduceat(transition[before, now], off[:-1]) + b.column("emission").to_numpy() if len(n) else np.zeros(0)
            base = b.column("base").to_numpy() - n * norm
            out = [b.column("doc_id"), b.column("held_out"), pa.array(n), b.column("n_known"), pa.array(np.full(len(n), n_train)), pa.array(base), pa.array(model), pa.array(10.0 ** np.minimum(-model / np.maximum(n, 1), 300))]
            yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in SCORED.split(", ")])

    return sequences.transform(arrow_map, finish, SCORED)
