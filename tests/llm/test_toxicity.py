import zlib

import pytest
from pyspark.sql import functions as F

from wayfold.llm import toxicity


def pattern(text, odds=None):
    found = toxicity.pattern_weights(text, toxicity.Lexicon(odds or {"scum": 5.0, "lowe*": 4.0}), toxicity.grammar())
    return {p: w for p, w in zip(toxicity.PATTERNS, found) if w}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("scum", {"insult": 5}),
        ("You are SCUM.", {"insult at target": 5}),
        ("scum, you", {"insult": 5}),
        ("he is not a scum", {"negated or reported": 5}),
        ("not that one would ever say scum", {"insult": 5}),
        ("She said they are scum", {"negated or reported": 5}),
        ("i will kill them", {"threat at target": 1}),
        ("kill the scum", {"both": 6}),
        ("loweisch! scum scum", {"insult": 14}),
        ("lowe", {}),
        ("", {}),
    ],
)
def test_clauses_match_patterns(text, expected):
    assert pattern(text) == expected


def test_composition_runs_one_machine_on_the_other():
    machine = toxicity.grammar()
    parts = [toxicity.negation(), toxicity.reported_speech(), toxicity.targets()]
    for text in ("oNoIoY", "RoIT", "NRIIY", "YTNT", "oooo", "NNNooI"):
        state, states = machine.start, [p.start for p in parts]
        for symbol in text:
            state = machine.step(state, symbol)[0]
            for k, part in enumerate(parts):
                states[k], symbol = part.step(states[k], symbol)
        assert machine.final.get(state) == parts[2].final.get(states[2])


@pytest.fixture
def tables(spark, words):
    texts = [f"{words(k, 30)}. {('scumbag', 'trashy', 'vile')[k % 3]}{'' if k % 3 else words(k, 1)[:2]} {words(k + 500, 10)}" if k % 4 == 0 else words(k, 40) for k in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "vile"), (900, None), (901, ""), (901, ""), (902, "x " * 50000)], "doc_id long, text string")
    labels = [(k, int(k % 4 == 0)) for k in range(400)]
    return docs.withColumn("score", F.lit("clash")), spark.createDataFrame([*labels, (None, 1), (900, 0), (5, None), (4, 1)], "doc_id long, toxic int")


def test_learns_and_scores(tables):
    docs, labels = tables
    model = toxicity.learn(docs, labels)
    assert "vile" in model["lexicon"] and "scu*" in model["lexicon"]
    rows = toxicity.score(docs.drop("score"), model, keep=["doc_id"]).collect()
    assert len(rows) == 405 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    # Beginnings of invented words may look like insults by chance.
    assert sum(r.predicted != (r.doc_id % 4 == 0) for r in rows if r.doc_id is not None and r.doc_id < 400) <= 4
    assert all(not r.predicted for r in rows if r.doc_id is not None and r.doc_id >= 900)


def test_held_out_labels_change_nothing(tables):
    docs, labels = tables
    fold = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id").isin(fold), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, flipped)
    marks = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert {r.doc_id for r in marks if r.h} == {k for k in [*range(400), 900, 901, 902] if zlib.crc32(str(k).encode()) % 5 == 0}


def test_without_labels_or_documents(tables):
    docs, labels = tables
    model = toxicity.learn(docs, labels.limit(0))
    assert not toxicity.score(docs, model, keep=["doc_id"]).where("predicted = 1").count()
    assert toxicity.score(docs.limit(0), model, keep=["doc_id"]).collect() == []
