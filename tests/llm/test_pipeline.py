import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayfold.llm.queries import QUERIES
from wayfold.llm.store import written


@pytest.fixture
def folder(spark, tmp_path, words):
    rng = random.Random(8)
    passage = words(900, 40)
    texts = [f"{words(k, 60)}\n{words(k + 300, 20)}\na line that all of them share" for k in range(120)]
    for k in range(0, 40, 4):
        texts[k] += "\nyou are vile scum, vile scum"
    texts[50] += " " + passage
    texts[60] = texts[61]
    # Near copies that share no whole line.
    texts[70] = words(700, 100)
    texts[71] = f"{words(700, 99)} other"
    ids = list(range(120))
    rng.shuffle(ids)
    rows = [(k, texts[k], "en", f"s{k % 3}", len(texts[k])) for k in ids] + [(500, None, None, None, None), (501, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k < 40 and k % 4 == 0)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_keep_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "stage")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert docs.columns[: len(columns)] == columns
    everyone = {*range(120), 500, 501}
    assert kept[0] == everyone - set(range(0, 40, 4))
    assert kept[1] == kept[0]
    # Of 61, a copy of 60, lines have left nothing that could be a near duplicate.
    assert kept[2] == kept[1] - {71}
    assert kept[3] == kept[4] == kept[2] - {50}
    assert docs.where("NOT restored OR n_tokens != size(ids)").count() == 0
    assert docs.where(F.col("text").contains("that all of them")).count() == 1
    assert docs.where("doc_id = 61").first().text == ""
    assert docs.where("n_chars != char_length(text)").count() == 0
    result = corpus_pipeline.run(spark, folder).drop("ids")
    assert sorted(map(tuple, result.collect()), key=str) == sorted(map(tuple, docs.drop("ids").collect()), key=str)


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_near_stage_drops_copies_at_82_percent(spark, documents, words):
    docs = documents([words(1, 150), f"{words(1, 150)} {words(2, 32)}", words(3, 150)])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [0, 2]
