"""Words that are hidden by spaces."""

import pyarrow as pa
import pytest

from lattica.llm import toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def language(spark):
    return toxicity.language_model(spark.read.parquet(f"{SF}/documents.parquet"))


def tokens(text, language, known=()):
    (owner, token), names = toxicity.restored_tokens(pa.array([text]), language, list(known))
    return [names[int(i)].as_py() for i in token]


@pytest.mark.parametrize("text", ["y o u i d i o t", "such a n i d i o t", "i d i o t a n d m o r o n", "they say you 1 d 1 0 t", "x y z i d i 0 t"])
def test_runs(language, text):
    got = tokens(text, language, ["idiot", "moron"])
    assert "idiot" in got and ("m o r o n" not in text or "moron" in got)


def test_boundaries(language):
    assert toxicity.restore("youidiot", language, spaced=True).split(" ")[-1] == "idiot"
    assert toxicity.restore("youidiot", language) == "youidiot"


@pytest.mark.parametrize("text", ["id iot", "you id i ot!", "an id\ni0t here", "the i diot", "id id iot"])
def test_split_words(language, text):
    assert "idiot" in tokens(text, language, ["idiot", "moron"])


def test_not_across_texts(language):
    (owner, token), names = toxicity.restored_tokens(pa.array(["an id", "iot", "", "mor", "on"]), language, ["idiot", "moron"])
    assert not {"idiot", "moron"} & set(names.to_pylist())


def test_no_repeats(language):
    got = tokens("idiot i d i o t id iot idiot", language, ["idiot"])
    assert got.count("idiot") == 1 and len(got) == len(set(got))


def test_evidence(language):
    model = toxicity.Model(language, ["w:idiot"], pa.array([3.0]).to_numpy())
    texts = ["you are an idiot", "y o u i d i o t", "you id iot", "a fine day", "i d e a s of it", None]
    assert model.evidence(pa.array(texts)).tolist() == [3.0, 3.0, 3.0, 0.0, 0.0, 0.0]
