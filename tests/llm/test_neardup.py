import random
import re

import numpy as np
import pytest

from wayfold.llm import components, neardup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return [(len(s), g) for s, g in zip(sets, group)]


def edited(text, edits, rng):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.random()}"
    return " ".join(w)


@pytest.fixture
def family(words):
    rng = random.Random(5)
    base, other = words(1, 200), words(2, 60)
    texts = [edited(base, rng.randrange(12), rng) for _ in range(60)]
    texts += [edited(other, rng.randrange(3), rng) for _ in range(30)]
    texts += [base.upper(), base, base, None, "", " \t", "a b c", "A b  c", "a b c d", "a b c d e", "a b c d e", words(3, 7), words(4, 12000)]
    # A passage that many share makes nobody a copy.
    texts += [f"{words(5, 40)} {words(100 + k, 30)}" for k in range(40)]
    return texts


def test_groups_equal_brute_force(documents, family):
    rows = sorted(neardup.near_duplicates(documents(family)).collect(), key=lambda r: r.doc_id)
    assert [(r.n_shingles, r.component_id) for r in rows] == plain(family)
    assert all(r.kept == (r.component_id == r.doc_id) for r in rows)


def test_missing_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", 1), (3, "a b c d e f", 2), (5, "A b c d e f", 3), (5, "A b c d e f", 3)], "doc_id long, text string, band long")
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert found == [(3, 3, True), (5, 3, False), (5, 3, False), (None, None, True)]
    assert neardup.near_duplicates(docs.limit(0)).collect() == []


def test_estimate_takes_chance_out():
    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    for shared in (0, 1000, 1800):
        b = np.sort(np.concatenate([a[rng.permutation(2000)[:shared]], rng.integers(0, 1 << 63, 2000 - shared, dtype=np.uint64)]))
        true = shared / (4000 - shared)
        assert abs(neardup.estimate(neardup.registers(a), neardup.registers(b), 2000, 2000) - true) < 0.12
    assert 0 < neardup.chance(10, 10) < 0.01


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    found = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 160)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_percent_reaches_every_step(documents, words):
    # Similarities 146 / 178 = 0.82, 4 / 5 = 0.8 and 146 / 183 = 0.798.
    texts = [words(1, 150), f"{words(1, 150)} {words(2, 32)}", words(3, 8), f"{words(3, 8)} x", words(4, 150), f"{words(4, 150)} {words(5, 37)}"]
    groups = lambda **kw: [r.component_id for r in sorted(neardup.near_duplicates(documents(texts), **kw).collect(), key=lambda r: r.doc_id)]
    assert groups() == [0, 1, 2, 3, 4, 5]
    assert groups(percent=80) == [0, 0, 2, 2, 4, 5]
    # 85 percent needs 6 of 7 shingles, 80 percent 4 of 5.
    assert (neardup.smallest(85), neardup.smallest(80)) == (6, 4)


def test_rare_pairs_at_80_percent(documents, words):
    # A chain of copies with a common hub, and pairs that only the rarest shingles bring together.
    rng = random.Random(9)
    texts = [edited(words(6, 200), rng.randrange(9), rng) for _ in range(60)] + [edited(words(7, 90), rng.randrange(4), rng) for _ in range(40)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    rows = sorted(neardup.near_duplicates(documents(texts), percent=80).collect(), key=lambda r: r.doc_id)
    assert [r.component_id for r in rows] == group
