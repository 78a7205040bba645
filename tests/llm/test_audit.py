import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from wayfold.llm.filteraudit import FILTERS, adjacent_swaps, audit, audit_filters

LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    """The report from sets of rows, one order after another."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed, parts = {name: set() for name in FILTERS}, {}
    for k, (i, text, part) in enumerate(rows):
        text, part = text or "", part or ""
        parts.setdefault(part, set()).add(k)
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        for name in FILTERS:
            if bad[name]:
                failed[name].add(k)
    out, removed_by = [], {}
    for part, members in parts.items():
        for order in permutations(FILTERS):
            left = set(members)
            for step, name in enumerate(order, 1):
                gone = left & failed[name]
                left -= gone
                others = set().union(*(failed[n] for n in FILTERS if n != name))
                removed_by[part, name] = removed_by.get((part, name), 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(members & failed[name]) - len(gone), len((members & failed[name]) - others),
                            sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone), name])
    return sorted((*row[:-1], removed_by[row[0], row[-1]]) for row in out)


def test_swaps_reach_every_order_once():
    order, seen = list(FILTERS), {FILTERS}
    for level in adjacent_swaps(len(FILTERS)):
        order[level : level + 2] = order[level + 1], order[level]
        seen.add("".join(order))
    assert len(seen) == len(adjacent_swaps(len(FILTERS))) + 1 == 120


def test_report_equals_plain_sets(spark, words):
    rng = random.Random(3)
    pool = [None, "", " \n", "ABC def", "a b #", words(5, 120), words(5, 120).upper(), words(6, 60) + " " + words(6, 60), words(7, 130) + " |", "ÀÉ x" * 40]
    rows = [(k, rng.choice(pool), rng.choice(["en", "de", None, ""])) for k in range(90)]
    rows += [(5, rows[5][1], "en"), (5, "other", None), (None, "", "en"), (None, "once", "fr")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 80)] + [(3, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mask", F.lit("x")).withColumn("part", F.lit("y"))
    found = audit_filters(docs, spark.createDataFrame(labels, LABELS).withColumn("n", F.lit(1)))
    assert sorted(map(tuple, found.collect())) == plain(rows, labels)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit_filters(docs, spark.createDataFrame([], LABELS)).collect() == []


def test_masks_may_be_missing():
    rows = audit({0: (7, 1, 0)})
    assert len(rows) == 600 and all(r["kept"] == 7 and r["removed"] == r["shapley"] == 0 for r in rows)
