"""Operators and stages leave columns alone whose names are those of their own results."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from wayfold.llm import bpe, decontaminate, toxicity
from wayfold.llm.store import free_names, written

CLASHING = ["score", "predicted", "patterns", "items", "spans", "n_words", "ids", "decoded", "restored", "n_tokens", "_text", "C0"]


def clashing(documents, words):
    docs = documents([words(1, 60), words(2, 60), None, "", "you are vile scum, vile scum"])
    return docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})


def unchanged(df, docs):
    kept = lambda x: sorted(map(str, x.select(*docs.columns).collect()))
    assert df.columns[: len(docs.columns)] == docs.columns
    assert kept(df) == kept(docs)


def test_free_names():
    assert free_names(["a", "b", "A"], ["A", "a_"]) == ["a__", "b", "A___"]


def test_results_get_names_of_their_own(spark, documents, words):
    docs = clashing(documents, words)
    benchmark = spark.createDataFrame([(1, words(2, 20))], "item_id long, text string")
    found = decontaminate.find_overlaps(docs, benchmark, keep=docs.columns)
    unchanged(found, docs)
    assert {r.doc_id: r.items_ for r in found.collect()}[1] == ["1"]
    scored = toxicity.score(docs, {"lexicon": {"scum": 3.0}, "weights": [0.0] * 2 * len(toxicity.PATTERNS) + [-5.0]}, keep=docs.columns)
    unchanged(scored, docs)
    assert scored.columns[-3:] == ["patterns_", "score_", "predicted_"]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(docs, ranks, decoded="decoded", restored="restored")
    unchanged(coded, docs)
    again = bpe.decode(coded, ranks, ids="ids_", decoded="decoded")
    assert again.columns[-1] == "decoded__"
    assert again.where("NOT restored_ OR decoded_ != decoded__").count() == 0


def test_pipeline_with_such_columns(spark, documents, words, tmp_path):
    spark.createDataFrame([(0, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(2, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = original = clashing(documents, words)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), "stage")
        unchanged(docs, original.join(docs.select("doc_id"), "doc_id", "left_semi").select(*original.columns))
    assert docs.where("NOT restored_ OR size(ids_) != n_tokens_").count() == 0


def test_long_pieces_and_slices(documents):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    given = ["ab" * 300 + " and", "x" * 255, "y" * 257, "0123456789" * 40, "é" * 9000, " ".join(f"w{k}x{k * k}" for k in range(30_000))]
    rows = sorted(bpe.encode(documents(given), ranks, restored="restored").collect(), key=lambda r: r.doc_id)
    assert [r.ids for r in rows] == [library.encode_ordinary(t) for t in given]
    assert all(r.restored for r in rows)
