import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import suffixdedup
from wayfold.llm.queries import QUERIES
from wayfold.llm.suffixdedup import COVER, LENGTH, RESIDUES, find_repeats, later_windows, stretches


def plain(rows, length=LENGTH):
    """(spans, kept) of each row (id, text), by a set of all windows so far."""
    order = sorted({(-(2**63) if i is None else i, hashlib.sha256((t or "").encode()).hexdigest(), (t or "").encode()) for i, t in rows})
    seen, out = set(), {}
    for i, _, raw in order:
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            window = raw[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[:-1], [False]]).astype(int))).reshape(-1, 2)
        out[i, raw] = [(int(a), int(b - a)) for a, b in edges], bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
    return sorted((((i, t), *out[-(2**63) if i is None else i, (t or "").encode()]) for i, t in rows), key=str)


def made(seed, n):
    """Texts that share passages, with periodic stretches and accents cut in the middle."""
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdeé .\n", k=400)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.randrange(4)
            base, a = rng.choice(pool), rng.randrange(300)
            parts.append(base[a : a + rng.randint(50, 250)] if kind < 2 else "ab" * rng.randint(1, 150) if kind == 2 else "".join(rng.choices("xyz", k=rng.randint(1, 99))))
        out.append("".join(parts))
    return out


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("spans", "kept", "_id")}).repartition(3)
    got = find_repeats(table, keep=table.columns, **options)
    assert got.columns == ["doc_id", "text", "spans", "kept", "_id", "n_bytes", "spans_", "kept_"]
    got = got.collect()
    assert all((r.spans, r.kept, r._id, r.n_bytes) == ("spans", "kept", "_id", len((r.text or "").encode())) for r in got)
    return sorted((((r.doc_id, r.text), [tuple(s) for s in r.spans_], bytes(r.kept_)) for r in got), key=str)


def test_cover_gives_every_distance():
    assert {(a - b) % COVER for a in RESIDUES for b in RESIDUES} == set(range(COVER))


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefgh"])
def test_sorted_windows_equal_a_set(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(20):
        base = bytes(rng.choices(alphabet, k=500))
        texts = [base[a : a + rng.randint(100, 300)] + bytes(rng.choices(b"xy", k=rng.randint(0, 30))) for a in rng.choices(range(200), k=9)]
        seen, expected = set(), []
        for t in texts:
            for p in range(len(t)):
                window = t[p : p + LENGTH]
                expected.append(len(window) == LENGTH and window in seen)
                seen.add(window)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        assert later_windows(np.frombuffer(b"".join(texts), np.uint8), bounds, LENGTH).tolist() == expected


def test_stretches_hold_every_window_once():
    texts = [t.encode() for t in made(4, 30)] + [b"", b"a" * 99, b"a" * 100]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    _, _, first, windows = stretches(np.frombuffer(b"".join(texts), np.uint8), offsets, LENGTH)
    starts = [p for a, n in zip(first.tolist(), windows.tolist()) for p in range(a, a + abs(n))]
    assert starts == [int(o) + p for o, t in zip(offsets, texts) for p in range(len(t) - LENGTH + 1)]


def test_equals_a_set_of_windows(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "BUCKET", 2000)
    monkeypatch.setattr(suffixdedup, "PIECE", 1000)
    texts = made(1, 80)
    texts[10:30] = [texts[10]] * 20
    texts[40] = "é" * 3000 + texts[3] + "é" * 50
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "short")]
    assert found(spark, rows) == plain(rows)


def test_repeats_within_one_text(spark):
    rows = [(0, "Nd, " * 60), (1, "q" * 101), (2, "abc" * 34 + "."), (3, "w" * 100), (4, "xyz" * 500 + "-" + "xyz" * 30)]
    assert found(spark, rows) == plain(rows)


def test_hot_marks_go_by_digest(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT", 3)
    rng = random.Random(6)
    line = "a line that very many of the documents hold somewhere, of over a hundred bytes, so that it goes from all but one"
    rows = [(k, "".join(rng.choices("abc ", k=150)) + line + "".join(rng.choices("abc ", k=rng.randint(0, 150)))) for k in range(40)]
    assert found(spark, rows) == plain(rows)


def test_ids_that_repeat_or_lack(spark):
    texts = made(2, 12)
    rows = [(1, texts[0] + "x" * 120), (1, "y" * 150 + texts[0]), (1, texts[0] + "x" * 120), (2, "x" * 130), (None, "y" * 120), (None, "z" * 40 + "y" * 120)]
    assert found(spark, rows) == plain(rows)


def test_no_documents_and_other_lengths(spark):
    assert found(spark, []) == []
    rows = [*enumerate(made(3, 20))]
    assert found(spark, rows, length=40) == plain(rows, 40)
    with pytest.raises(ValueError):
        find_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=[], length=8)


def test_query_equals_a_set_of_windows(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    expected = {i: (len((t or "").encode()), sum(n for _, n in spans), len(spans), hashlib.sha256(kept).hexdigest()) for (i, t), spans, kept in plain(rows)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op11_suffix_dedup"](spark, folder).collect()}
    assert got == expected
    assert sum(x[1] for x in got.values()) > 0
