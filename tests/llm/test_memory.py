"""What kernels hold at once, and what executors give back."""

import gc
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import common, pieces, registry

SMALL = "/root/testdata/sf0.001"


def test_pieces_memory():
    """Encoding and decoding take a bounded multiple of the text, however many ids it has."""
    pytest.importorskip("sentencepiece")
    model = pieces.load(registry.MODEL_PATH)
    words = "".join(f"w{i * 7919 % 1000} ; " for i in range(1000))
    texts = [words * 4] * 128
    size = sum(map(len, texts))
    tracemalloc.start()
    try:
        ids, off = pieces.encode(model, pa.array(texts))
        held, peak = tracemalloc.get_traced_memory()
        tracemalloc.reset_peak()
        said = pieces.decode(model, ids, off)
        back = tracemalloc.get_traced_memory()[1] - held
    finally:
        tracemalloc.stop()
    assert said == texts
    print(f"{size} bytes, {len(ids)} ids: encoding takes {peak / size:.1f} x, decoding {back / size:.1f} x")
    assert peak + back < 20 * size


def test_gather():
    """Slices of any size, some of more places than are worked out at once."""
    rng = np.random.default_rng(1)
    off = np.r_[0, np.cumsum(np.r_[rng.integers(0, 9, 500), 3 * pieces.GATHERED, 0])]
    values = rng.integers(0, 99, off[-1]).astype(np.int32)
    for which in (np.r_[rng.integers(0, 502, 90_000), 500, 501, 500, 3], np.array([501, 501]), np.zeros(0, np.int64)):
        which = which[(which != 500) | (np.arange(len(which)) >= 90_000)]
        got, size = pieces.gather(values, off, which)
        slices = [values[off[i] : off[i + 1]] for i in which]
        assert got.dtype == values.dtype and size.tolist() == [len(x) for x in slices]
        assert np.array_equal(got, np.concatenate([*slices, values[:0]]))


def test_free_heaps(spark):
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    held = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.long, 100_000_000)  # 800 MB
    before = runtime.totalMemory()
    del held
    gc.collect()
    common.free_heaps(spark)
    assert runtime.totalMemory() < before - (200 << 20)


def test_stages_free_heaps(spark, monkeypatch):
    """Each stage of the pipeline after the first begins with heaps that were freed."""
    freed = []
    monkeypatch.setattr(corpus_pipeline, "free_heaps", freed.append)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL)
        assert len(freed) == k
