import random

import pytest
from pyspark import cloudpickle

import wayfold

cloudpickle.register_pickle_by_value(wayfold)

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def words():
    """Invented words, the same in every run."""
    return lambda seed, n: " ".join("".join(random.Random(seed * 1000 + k).choices("abcdefgh", k=6)) for k in range(n))


@pytest.fixture
def documents(spark):
    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, DOC)

    return make
