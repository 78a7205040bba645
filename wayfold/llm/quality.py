"""Quality rules: simple counts, and bands of perplexity under a modified Kneser-Ney model of byte n-grams.

Spark counts the n-grams of each language over the whole corpus and smooths them order by order with joins. The model is
kept as arrays of n-gram hashes in order with their log probabilities, in pieces of bounded size for broadcasting. Each
language has its own band, taken from the perplexities of its documents; what lies below (repetition) or above (noise) is
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import BASE, NOT_SPACE, Words, mix, per_text, runs, span_hashes, text_blocks
from wayfold.llm.store import written

#: Bytes in an n-gram; contexts before a text's start are line breaks.
ORDER = 5
#: Bytes of sorted arrays broadcast at once; a larger model is scored piece by piece.
PIECE = 128 << 20
#: Entries a counting task holds before it hands on what it has.
HELD = 1 << 20
#: Widths of the band below and above a language's median, in median absolute deviations, and what is added for short texts.
#: Chosen on the even ids of sf0.1 as the widths that reject most texts labelled junk and at most 1 % of those labelled clean.
BELOW, ABOVE, SHORT = 4.0, 4.0, 1.0

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
NEEDED_WORDS, REPEATED_PERCENT = 50, 50
#: Log probability of an n-gram that the model does not have.
UNSEEN = -12.0


def language_key(lang: Column) -> Column:
    """23 bits that stand for a language in front of its n-grams; a null language is one of its own."""
    return F.pmod(F.xxhash64(F.coalesce(lang, F.lit(""))), F.lit(1 << 23))


def byte_ngrams(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte, as language key and bytes in one number."""
    pad = ORDER - 1
    lengths = np.diff(offsets)
    at = np.arange(len(data)) + pad * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    wide = np.full(len(data) + pad * len(lengths), 0x0A, np.int64)
    wide[at] = data
    out = np.repeat(keys << 8 * ORDER, lengths)
    for k in range(ORDER):
        out |= wide[at - k] << 8 * k
    return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def count_ngrams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(key, c): occurrences of each n-gram of the whole table; tasks add up their own before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        ready = lambda kc: pa.RecordBatch.from_arrays([pa.array(kc[0]), pa.array(kc[1])], names=["key", "c"])
        for batch in batches:
            languages = batch.column(1).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in text_blocks(batch.column(0)):
                if len(data):
                    held.append(np.unique(byte_ngrams(data, offsets, languages[first:last]), return_counts=True))
                if sum(len(k) for k, _ in held) > HELD:
                    held = [_merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield ready(held.pop())
        if held:
            yield ready(_merged(held))

    rows = docs.select(F.col(text).alias("text"), language_key(F.col(lang)).alias("key"))
    return rows.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _low(order: int) -> int:
    return (1 << 8 * order) - 1


def _language(key: str = "key") -> Column:
    return F.shiftright(key, 8 * ORDER)


def discounts(grams: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): the three discounts of each language, from how many n-grams have counts one to four."""
    n = [F.sum((F.col("c") == k).cast("long")).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    by = grams.groupBy(_language().alias("lang")).agg(*n)
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    found = [k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")) for k in (1, 2, 3)]
    # Too few n-grams to tell: half of what a count at least is.
    ok = [F.when((d > 0) & (d < k), d).otherwise(k / 2).alias(f"d{k}") for k, d in zip((1, 2, 3), found)]
    return by.select("lang", *ok)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(key, logp) of every n-gram counted: interpolated modified Kneser-Ney with as many orders as an n-gram has bytes.

    Lower orders count the different n-grams that end alike instead of occurrences. No join has a hot side: a context is
    followed by at most 256 bytes.
    """
    grams = {ORDER: written(counts, "grams")}
    for order in range(ORDER - 1, 0, -1):
        shorter = _language() * (1 << 8 * ORDER) + F.col("key").bitwiseAND(_low(order))
        grams[order] = written(grams[order + 1].groupBy(shorter.alias("key")).agg(F.count("*").alias("c")), "grams")
    lower = None
    for order in range(1, ORDER + 1):
        context = _language() * (1 << 8 * ORDER) + F.shiftright(F.col("key").bitwiseAND(_low(order)), 8)
        # Written first: a language may hold most rows, and only a table of known size can be broadcast or split against it.
        found = written(discounts(grams[order]).withColumnRenamed("lang", "_lang"), "discounts")
        rows = grams[order].join(found, _language() == F.col("_lang")).drop("_lang")
        discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.select("key", "c", discount.alias("d"), context.alias("context"))
        totals = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
        rows = rows.join(totals, "context")
        if lower is None:
            below = F.lit(1 / 256)
        else:
            shorter = _language() * (1 << 8 * ORDER) + F.col("key").bitwiseAND(_low(order - 1))
            rows = rows.withColumn("shorter", shorter).join(lower.toDF("shorter", "q"), "shorter")
            below = F.col("q")
        lower = rows.select("key", ((F.col("c") - F.col("d") + F.col("left") * below) / F.col("total")).alias("p"))
    return written(lower.select("key", F.log("p").cast("float").alias("logp")), "model")


def sorted_pieces(model: DataFrame, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes in order, log probabilities) of the model, each piece no larger than the driver and a broadcast may hold."""
    rows = model.count()
    pieces = max(1, -(-rows * 12 // piece)) if rows else 0
    pieces += pieces > 1  # hashed pieces are not quite equal
    for k in range(pieces):
        part = model if pieces == 1 else model.where(F.pmod(F.xxhash64("key"), F.lit(pieces)) == k)
        table = part.toArrow()
        hashes = mix(table.column("key").to_numpy().astype(np.uint64))
        order = np.argsort(hashes)
        yield hashes[order], table.column("logp").to_numpy()[order]


def directory(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """Where the hashes with each leading bits start, and by how many bits to shift for these."""
    bits = max(1, int(len(hashes)).bit_length())
    starts = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return starts.astype(np.int32), 64 - bits


def look_up(wanted: np.ndarray, hashes: np.ndarray, values: np.ndarray, starts: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted hashes there are, and their values."""
    top = (wanted >> np.uint64(shift)).astype(np.int64)
    at, stop = starts[top].astype(np.int64), starts[top + 1]
    out, found = np.zeros(len(wanted), np.float32), np.zeros(len(wanted), bool)
    left = np.flatnonzero(at < stop)
    while len(left):
        hit = hashes[at[left]] == wanted[left]
        done = left[hit]
        out[done], found[done] = values[at[done]], True
        left = left[~hit]
        at[left] += 1
        left = left[at[left] < stop[left]]
    return found, out


def counts_of(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words, code points in words, symbols, repeated lines and words in repeated windows of each text."""
    words = Words(data, offsets, NOT_SPACE, fold=False)
    texts = len(offsets) - 1
    starts, ends = runs(data != 0x0A, offsets)
    held = np.concatenate([[0], np.cumsum(NOT_SPACE[data])])
    worded = held[ends] > held[starts]
    starts, ends = starts[worded], ends[worded]
    line_text = np.searchsorted(offsets, starts, "right") - 1
    keys = span_hashes(data, starts, ends) + line_text.astype(np.uint64) * BASE
    first = np.unique(keys, return_index=True)[1]
    lines = np.bincount(line_text, minlength=texts) - np.bincount(line_text[first], minlength=texts)
    at, hashes = words.windows(3)
    owner = words.texts()
    _, which, seen = np.unique(hashes + owner[at].astype(np.uint64) * BASE, return_inverse=True, return_counts=True)
    twice = at[seen[which] > 1] if len(at) else at
    repeated = np.zeros(len(words), bool)
    for k in range(3):
        repeated[twice + k] = True
    return {
        "n_words": np.diff(words.first),
        "word_chars": per_text(NOT_SPACE[data] & (data & 0xC0 != 0x80), offsets),
        "n_symbols": per_text(SYMBOLS[data], offsets),
        "n_dup_lines": lines,
        "n_repeat_words": per_text(repeated, words.first),
    }


BASE_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def score(docs: DataFrame, model: DataFrame, *, doc_id: str, text: str, lang: str, piece: int = PIECE) -> DataFrame:
    """(doc_id, language, the base counts, n_bytes, logp: the sum of log probabilities of all bytes) of every row."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), language_key(F.col(lang)).alias("language"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text")
    )

    def scoring(shared, with_counts: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, values, starts, shift = shared.value
            for batch in batches:
                languages = batch.column(1).to_numpy(zero_copy_only=False)
                parts: dict[str, list] = {}
                for first, last, data, offsets in text_blocks(batch.column(3)):
                    found, logp = look_up(mix(byte_ngrams(data, offsets, languages[first:last]).astype(np.uint64)), hashes, values, starts, shift)
                    sums = np.concatenate([[0.0], np.cumsum(logp, dtype=np.float64)])
                    new = counts_of(data, offsets) if with_counts else {}
                    new |= {"n_bytes": np.diff(offsets), "n_found": per_text(found, offsets), "logp": np.diff(sums[offsets])}
                    for name, values_ in new.items():
                        parts.setdefault(name, []).append(values_)
                columns = {name: np.concatenate(x) for name, x in parts.items()}
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(x, pa.float64() if n == "logp" else pa.int64()) for n, x in columns.items()]], names=[*batch.schema.names[:3], *columns])

        counts = "".join(f", {c} long" for c in BASE_COUNTS) if with_counts else ""
        return run, f"doc_id {kind}, language long, row long{counts}, n_bytes long, n_found long, logp double"

    out, more = None, None
    pieces = sorted_pieces(model, piece)
    for number, (hashes, values) in enumerate(pieces):
        shared = spark.sparkContext.broadcast((hashes, values, *directory(hashes)))
        part = rows.mapInArrow(*scoring(shared, number == 0))
        if number == 0:
            out = written(part, "scores")
        else:
            # Rows alike in id, language and text have equal sums; one of them stands for all.
            part = part.dropDuplicates(["doc_id", "language", "row"]).select("doc_id", "language", "row", "n_found", "logp")
            more = part if more is None else more.union(part)
    if out is None:
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.float32))
        out = rows.mapInArrow(*scoring(spark.sparkContext.broadcast((*empty, *directory(empty[0]))), True))
    if more is not None:
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("doc_id", "language", "row")]
        sums = more.groupBy("doc_id", "language", "row").agg(F.sum("n_found").alias("f"), F.sum("logp").alias("l")).alias("m")
        joined = out.alias("s").join(sums, same[0] & same[1] & same[2], "left")
        out = joined.select("s.doc_id", "s.language", *BASE_COUNTS, "n_bytes", (F.col("n_found") + F.coalesce("f", F.lit(0))).alias("n_found"), (F.col("logp") + F.coalesce("l", F.lit(0.0))).alias("logp"))
    unseen = (F.col("n_bytes") - F.col("n_found")) * UNSEEN
    return out.select("doc_id", "language", *BASE_COUNTS, "n_bytes", (F.col("logp") + unseen).alias("logp"))


def judge_quality(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", piece: int = PIECE) -> DataFrame:
    """(doc_id, the base counts, base_failed, entropy: nats a byte, lower, upper, kept) of every row.

    Null and empty texts have no words and fail. A text is kept if it passes the base rules and its entropy lies in its
    language's band. Rows that repeat are counted and judged each; a language with one text keeps it.
    """
    model = kneser_ney(count_ngrams(docs, text, lang))
    scored = score(docs, model, doc_id=doc_id, text=text, lang=lang, piece=piece)
    failed = (F.col("n_words") < NEEDED_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    entropy = -F.col("logp") / F.greatest(F.col("n_bytes"), F.lit(1))
    scored = written(scored.withColumns({"base_failed": failed, "entropy": entropy}), "judged")
    passed = scored.where("NOT base_failed")
    middle = written(passed.groupBy("language").agg(F.percentile_approx("entropy", 0.5, 1000).alias("middle")), "middles")
    off = passed.join(middle, "language").withColumn("off", F.abs(F.col("entropy") - F.col("middle")))
    spread = off.groupBy("language").agg(F.percentile_approx("off", 0.5, 1000).alias("spread"))
    bands = written(middle.join(spread, "language"), "spreads")
    # Entropy varies more over few bytes.
    short = SHORT / F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1)))
    judged = scored.join(bands, "language", "left").withColumns({
        "lower": F.col("middle") - BELOW * F.col("spread") - short, "upper": F.col("middle") + ABOVE * F.col("spread") + short,
    })
    kept = ~F.col("base_failed") & F.coalesce(F.col("entropy").between(F.col("lower"), F.col("upper")), F.lit(False))
    return judged.select("doc_id", *BASE_COUNTS, "n_bytes", "base_failed", "entropy", "lower", "upper", kept.alias("kept"))
