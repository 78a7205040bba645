import re

import pytest
from pyspark.sql import functions as F

from wayfold.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = "item_id long, text string"


def plain(texts, items, window=10):
    known = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            known.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, found = WORD.findall((text or "").translate(LOWER)), set(), set()
        for gram, ids in known.items():
            for k in range(len(w) - len(gram) + 1):
                if tuple(w[k : k + len(gram)]) == gram:
                    hit.update(range(k, k + len(gram)))
                    found |= ids
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.fixture
def case(words):
    passage = words(1, 14)
    texts = [
        f"{words(2, 20)} {passage.upper()} {words(3, 5)}", f"{passage} {passage}", words(4, 9), None, "", "!!! ...", "Äpfel, 12 Birnen",
        words(5, 30000) + " " + " ".join(passage.split()[2:13]), f"{passage} {passage}", " ".join(passage.split()[:9]),
    ]
    items = [(7, passage), (10, passage), (3, "äpfel 12"), (4, "Äpfel 12 birnen"), (5, None), (6, "  "), (None, words(6, 40))]
    return texts, items


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_hits_equal_brute_force(spark, documents, case, block):
    texts, items = case
    found = d.find_overlaps(documents(texts), spark.createDataFrame(items, ITEM), keep=["doc_id"], block=block)
    rows = found.select("doc_id", "n_words", d.covered_words(F.col("spans")).alias("n"), "items").collect()
    assert [(r.n_words, r.n, r["items"]) for r in sorted(rows, key=lambda r: r.doc_id)] == plain(texts, items)


def test_spans_or_documents_go(spark, words):
    passage = words(1, 12)
    docs = spark.createDataFrame([(None, f"Start, {passage}; end.", 1), (2, "clean text", 2), (2, None, 3)], "doc_id long, text string, spans long")
    bench = spark.createDataFrame([(1, passage)], ITEM)
    cut = d.decontaminate(docs, bench, remove="spans")
    assert cut.columns == docs.columns
    assert {(r.doc_id, r.text) for r in cut.collect()} == {(None, "Start, ; end."), (2, "clean text"), (2, None)}
    assert {r.spans for r in d.decontaminate(docs, bench).collect()} == {2, 3}


def test_empty_tables(spark, documents):
    docs, bench = documents(["a b c"]), spark.createDataFrame([(1, "a b")], ITEM)
    assert d.find_overlaps(docs.limit(0), bench, keep=["doc_id"]).collect() == []
    assert d.find_overlaps(docs, bench.limit(0), keep=["doc_id"]).first()["items"] == []
