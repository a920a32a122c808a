"""Each stage of the pipeline against brute force over its own input, and run() against the stages one by one."""

import hashlib
import os
import sys
from itertools import combinations

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_neardup import brute_leaks, brute_lines, classes, low

import corpus_pipeline
from lattica.llm import registry, toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(path := f"{tmp_path}/{len(seen)}")
        out = spark.read.parquet(path)
        seen.append((name, {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}, out.columns))
        docs = out
    assert [n for n, *_ in seen] == ["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "sentencepiece"]
    assert all(c == columns for *_, c in seen[:-1])

    _, before, after, _ = seen[0]
    scores = {r.doc_id: r.predicted for r in toxicity.score(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    assert set(after) == {i for i in before if not scores[i]}

    _, before, after, _ = seen[1]
    gone, _ = brute_lines([(i, r.text) for i, r in before.items()])
    assert {i: r.text for i, r in after.items()} == {i: "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in gone[i]) for i, r in before.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())

    _, before, after, _ = seen[2]
    ids = sorted(before)
    words = [low(before[i].text).split() for i in ids]
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    near = [(a, b) for a, b in combinations(range(len(ids)), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    empty = [k for k, x in enumerate(sets) if not x]  # texts without words are one class
    near += list(zip(empty[:-1], empty[1:]))
    assert sorted(after) == sorted(ids[c] for c in set(classes(len(ids), near)))

    _, before, after, _ = seen[3]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    ids = sorted(before)
    assert set(after) == set(ids) - {ids[i] for i, _, _ in brute_leaks([before[i].text for i in ids], bench)}

    _, before, after, _ = seen[4]
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=registry.MODEL_PATH)
    assert {i: list(r.token_ids) for i, r in after.items()} == {i: sp.encode(r.text) for i, r in before.items()}
    assert all(r.decoded_md5 == hashlib.md5(before[i].text.encode()).hexdigest() for i, r in after.items())

    whole = {r.doc_id: list(r.token_ids) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert whole == {i: list(r.token_ids) for i, r in after.items()}


def test_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
