import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wayfold.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(repeated)


def plain_model(texts, order=quality.ORDER):
    """Interpolated modified Kneser-Ney over bytes, from dictionaries; the mean negative log probability of each text."""
    grams = {order: Counter()}
    for t in texts:
        raw = b"\n" * (order - 1) + t.encode()
        grams[order].update(raw[k : k + order] for k in range(len(raw) - order + 1))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    p = {b"": 1 / 256}
    for k in range(1, order + 1):
        n = Counter(min(c, 5) for c in grams[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        d = []
        for j in (1, 2, 3):
            value = j - (j + 1) * y * n[j + 1] / n[j] if n[j] and n[1] + n[2] else 0
            d.append(value if 0 < value < j else j / 2)
        total, left = Counter(), defaultdict(float)
        for g, c in grams[k].items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        for g, c in grams[k].items():
            p[g] = (c - d[min(c, 3) - 1] + left[g[:-1]] * p[g[1:]]) / total[g[:-1]]
    out = []
    for t in texts:
        raw = b"\n" * (order - 1) + t.encode()
        out.append(-sum(math.log(p[raw[k : k + order]]) for k in range(len(raw) - order + 1)) / max(1, len(t.encode())))
    return out


@pytest.mark.parametrize("piece", [1 << 20, 3000])
def test_perplexity_equals_a_plain_model(spark, documents, words, piece):
    texts = [words(k, 30) for k in range(12)] + ["", "é" * 50, words(3, 30)]
    rows = {r.doc_id: r for r in quality.judge_quality(documents(texts), piece=piece).collect()}
    assert [rows[k].entropy for k in range(len(texts))] == pytest.approx(plain_model(texts), abs=1e-4)


def test_counts_and_verdicts(spark, words):
    rng = random.Random(4)
    normal = [words(k % 7 * 50 + k, 120) for k in range(40)]
    odd = ["".join(chr(rng.randrange(33, 1500)) + " " * (k % 4 == 0) for k in range(900)), "a b c\n" * 60, None, "", " \n\t", "x", "line one\nline one\n\nLine one\n# $ *", words(1, 20000)]
    rows = [(k, t, ("en", None)[k % 2], 1) for k, t in enumerate(normal + odd)]
    docs = spark.createDataFrame([*rows, (None, normal[0], "en", 1), (0, normal[0], "en", 1)], "doc_id long, text string, lang string, language long")
    found = quality.judge_quality(docs).collect()
    assert len(found) == len(rows) + 2
    by_id = {r.doc_id: r for r in found}
    for k, text, _, _ in rows:
        counts = plain_counts(text)
        r = by_id[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)
    # The first text is there three times, which makes it easy to predict; bands of so few texts are narrow.
    assert sum(by_id[k].kept for k in range(1, 40)) >= 36 and not by_id[40].kept
    assert quality.judge_quality(docs.limit(0)).collect() == []
    assert docs.select(F.col("lang")).count() == len(found)


def test_mild_junk_lies_outside_the_band(documents):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    vocabulary = [word() for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=200)) for _ in range(80)]
    # Every eighth word is made of random letters.
    texts.append(" ".join(w if k % 8 else word() for k, w in enumerate(rng.choices(vocabulary, k=200))))
    kept = {r.doc_id: r.kept for r in quality.judge_quality(documents(texts)).collect()}
    assert [k for k in kept if not kept[k]] == [80]
