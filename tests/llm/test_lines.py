import random

import pytest
from pyspark.sql import functions as F

from wayfold.llm import linededup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    owner = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10 and doc is not None:
                owner.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < 10 or doc == min(owner[key(x)])]
        out.append((doc, len(lines), "\n".join(kept)))
    return out


@pytest.fixture
def rows():
    rng = random.Random(2)
    pool = [f"Line number {k} of the pool" for k in range(30)] + ["short", "", "  \t", "ÄÖÜ äöü ÄÖÜ 123", "äÖÜ äöü ÄÖÜ 123", "\u00a0padded by a hard space\u00a0"]
    made = [(k, "\n".join(rng.choice(("", " ", "\t\r")) + rng.choice((str, str.upper))(rng.choice(pool)) for _ in range(rng.randrange(12)))) for k in range(120)]
    hot = "the line that everybody has"
    made = [(k, f"{t}\n{hot}" if k % 2 else t) for k, t in made]
    return [*made, (200, None), (201, ""), (202, "\n\n"), (None, hot), (203, f"{hot}\n{hot}"), (203, f"{hot}\n{hot}"), (204, "only here but twice\n" * 3), (300, "very long line " * 5000 + "\n" + hot)]


@pytest.mark.parametrize("batches", [1, 5])
def test_kept_lines_equal_brute_force(spark, rows, batches):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = linededup.mark_lines(docs, batches=batches).select("doc_id", "_n_lines", F.array_join("_kept", "\n").alias("kept")).collect()
    assert sorted(((r.doc_id, r._n_lines, r.kept) for r in found), key=str) == sorted(plain(rows), key=str)


def test_columns_stay(spark):
    docs = spark.createDataFrame([(1, "one line of text\nx", 5), (2, "One line of text\ny", 6), (3, None, 7)], "doc_id long, text string, h1 long")
    out = linededup.dedup_lines(docs.withColumnRenamed("h1", "_kept"))
    assert out.columns == ["doc_id", "text", "_kept"]
    assert {tuple(r) for r in out.collect()} == {(1, "one line of text\nx", 5), (2, "y", 6), (3, None, 7)}
    assert linededup.dedup_lines(docs.limit(0)).collect() == []


def test_runs_are_merged_by_level(spark):
    store = linededup.LineStore(spark, buckets=3)
    for k in range(5):
        lines = spark.range(k * 10, k * 10 + 15).select(F.lit(k).cast("long").alias("doc"), F.lit(0).cast("long").alias("row"), F.lit(0).alias("pos"), F.col("id").alias("h1"), F.lit(7).cast("long").alias("h2"))
        dropped = store.add(lines)
        assert dropped.count() == (5 if k else 0)
    store.compact()
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert sum(run.count() for run in store.runs()) == 55
    store.close()
    assert not store.runs()
