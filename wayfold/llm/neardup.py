"""Near-duplicate groups by HyperMinHash sketches of word shingles.

Each document's distinct shingles fall into buckets by their hash. For each of several hash functions a bucket keeps its
least value, compressed to a leading-zero count and some mantissa bits. Bands of these registers propose candidates, the
registers estimate the similarity with chance agreement taken out, and candidates that may reach the threshold are
compared on their full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import BASE, NOT_SPACE, Words, mix, once, text_blocks
from wayfold.llm.components import components
from wayfold.llm.store import written

SHINGLE = 5
#: Links have 100 * intersection >= percent * union, with this percent where none is given.
PERCENT = 85
#: Buckets of a document's shingles, and hash functions applied to each bucket.
BUCKETS, SEEDS = 16, 14
#: Mantissa bits of a register; the leading-zero count takes the other six.
MANTISSA = 10
#: Registers in a band. 37 bands of 6 miss a pair at the threshold with probability (1 - 0.85 ** 6) ** 37 = 2e-8 for 85 percent
#: and (1 - 0.8 ** 6) ** 37 = 1.3e-5 for 80.
ROWS = 6
BANDS = BUCKETS * SEEDS // ROWS
#: Candidates whose estimate is below this are not compared; an estimate at a threshold of 80 percent has a deviation of 0.03.
FLOOR = 0.6
#: Bits of the filter that says which documents' sets are wanted.
FILTER_BITS = 1 << 24
#: Counters that order shingles by how common they are.
COUNTERS = 1 << 20


def smallest(percent: int) -> int:
    """Fewer shingles than this can only reach the threshold by equality: n of n + 1 must pass."""
    if not 0 < percent < 100:
        raise ValueError("percent must lie between 1 and 99")
    return -(-percent // (100 - percent))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes in order; a text of fewer words has one shingle of all of them."""
    words = Words(data, offsets, NOT_SPACE, fold=True)
    at, hashes = words.windows(SHINGLE)
    bounds = np.searchsorted(at, words.first)
    counts = np.diff(words.first)
    short: dict[int, np.ndarray] = {}
    for size in range(1, SHINGLE):
        chosen = np.flatnonzero(counts == size)
        if len(chosen):
            first, whole = words.windows(size)
            where = np.searchsorted(first, words.first[chosen])
            short |= {int(t): mix(whole[w : w + 1] ^ np.uint64(size)) for t, w in zip(chosen, where)}
    for t, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        yield short[t] if t in short else np.unique(hashes[a:b])


def registers(shingles: np.ndarray) -> np.ndarray:
    """SEEDS x BUCKETS registers of sorted distinct hashes: 1 + the compressed least value, or 0 for an empty bucket."""
    out = np.zeros((SEEDS, BUCKETS), np.uint16)
    used, first = np.unique((shingles >> np.uint64(60)).astype(np.int64), return_index=True)
    shifts = np.arange(1, SEEDS + 1, dtype=np.uint64) * BASE
    at_once = max(1, (1 << 18) // max(1, len(shingles)))
    for k in range(0, SEEDS, at_once):
        values = mix(shingles + shifts[k : k + at_once, None])
        out[k : k + at_once, used] = compress(np.minimum.reduceat(values, first, axis=1))
    return out.ravel()


def compress(values: np.ndarray) -> np.ndarray:
    """Leading-zero count (at most 62) and the mantissa bits after the first one bit, in 16 bits; never 0."""
    exponent = np.zeros(values.shape, np.int64)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        small = rest < np.uint64(1) << np.uint64(64 - step)
        exponent[small] += step
        rest[small] <<= np.uint64(step)
    mantissa = (rest << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return (((np.minimum(exponent, 62) + 1) << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint16)


def _register_order() -> np.ndarray:
    """Registers one hash function after another, each with its buckets in an order of its own, so that bands combine different buckets."""
    buckets, shifts = np.arange(BUCKETS, dtype=np.uint64), np.arange(1, SEEDS + 1, dtype=np.uint64) * BASE
    order = np.argsort(mix(buckets + shifts[:, None]), axis=1) + np.arange(SEEDS)[:, None] * BUCKETS
    return order.ravel()[: BANDS * ROWS]


def band_keys(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sketch a 64-bit key of each band, and whether the band holds any register."""
    rows = sketches[:, once("register order", _register_order)].reshape(-1, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * BASE, rows.shape[:2])
    for k in range(ROWS):
        keys = mix(keys + rows[:, :, k].astype(np.uint64) * np.uint64(2 * k + 1))
    return keys.view(np.int64), rows.any(axis=2)


def chance(size_a: int, size_b: int) -> float:
    """Probability that registers of disjoint buckets with so many values agree.

    A least value of n uniform ones exceeds x with probability (1 - x) ** n; summed over the intervals a register can say.
    """
    zeros = np.arange(0, 40)[:, None]
    low = np.ldexp(1 + np.arange(1 << MANTISSA)[None, :] / (1 << MANTISSA), -zeros - 1)
    high = np.minimum(low + np.ldexp(1.0, -zeros - 1 - MANTISSA), 1)
    p = [(1 - low) ** n - (1 - high) ** n for n in (size_a, size_b)]
    return float((p[0] * p[1]).sum())


def _rounded(n: float) -> int:
    """n to two binary digits: the chance of agreement hardly changes within."""
    n = max(1, round(n))
    shift = max(0, n.bit_length() - 2)
    return n >> shift << shift


def estimate(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> float:
    """Jaccard estimate from two sketches, corrected for registers that agree by chance."""
    used = (a > 0) | (b > 0)
    agree = ((a == b) & used).sum() / max(1, used.sum())
    sizes = _rounded(size_a / BUCKETS), _rounded(size_b / BUCKETS)
    c = once(f"chance {sizes}", lambda: chance(*sizes))
    return float((agree - c) / (1 - c))


def sketch(docs: DataFrame, doc_id: str, text: str, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, registers) of every document."""
    least = smallest(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for _, _, data, offsets in text_blocks(batch.column(1)):
                for shingles in shingle_sets(data, offsets):
                    sizes.append(len(shingles))
                    digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    sketches.append(registers(shingles).tobytes() if len(shingles) >= least else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "registers"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, registers binary")


def bands(sketches: DataFrame) -> DataFrame:
    """(band key, id) for each band of each sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16)
            keys, held = band_keys(raw.reshape(-1, SEEDS * BUCKETS))
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), held.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(keys[held], pa.int64()), pa.array(ids, pa.int64())], names=["band", "id"])

    return sketches.select("doc_id", "registers").mapInArrow(run, "band long, id long")


def similar_sizes(n: Column, m: Column, percent: int = PERCENT) -> Column:
    """Sets of such sizes can reach the threshold at all."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def promising(pairs: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sizes and estimate may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(2, 6)))
            keep = [estimate(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), n, m) >= FLOOR for x, y, n, m in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = sketches.select("doc_id", "n_shingles", "registers")
    joined = pairs.join(side.toDF("a", "n_a", "r_a"), "a").join(side.toDF("b", "n_b", "r_b"), "b")
    joined = joined.where(similar_sizes(F.col("n_a"), F.col("n_b"), percent))
    return joined.select("a", "b", "r_a", "r_b", "n_a", "n_b").mapInArrow(run, "a long, b long").distinct()


def _filter_bit(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def _filter_words(ids: DataFrame) -> np.ndarray:
    """A bit for each hashed id, of a size that does not depend on how many there are."""
    words = ids.select(_filter_bit(F.col("id")).alias("bit")).selectExpr("CAST(bit DIV 64 AS INT) AS w", "shiftleft(1L, CAST(bit % 64 AS INT)) AS m")
    found = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[found.column("w").to_numpy()] = found.column("m").to_numpy().view(np.uint64)
    return out


def _maybe(words: np.ndarray, bits: pa.Array) -> pa.Array:
    at = bits.to_numpy(zero_copy_only=False)
    return pa.array((words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1)


def only_ids(sketches: DataFrame, ids: DataFrame) -> DataFrame:
    """The sketches of the documents in ids. A fixed-size filter drops most others before the exact join moves anything."""
    wanted = sketches.sparkSession.sparkContext.broadcast(_filter_words(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(_maybe(wanted.value, batch.column(0))).select(["doc_id", "n_shingles", "registers"])

    rows = sketches.select(_filter_bit(F.col("doc_id")).alias("bit"), "doc_id", "n_shingles", "registers")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, registers binary").join(ids.toDF("doc_id"), "doc_id", "left_semi")


def full_sets(docs: DataFrame, doc_id: str, text: str, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents in ids. A fixed-size filter spares most other texts; the join is exact."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(_filter_words(ids))
    bit = _filter_bit(F.col(doc_id).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(_maybe(wanted.value, batch.column(2)))
            for first, last, data, offsets in text_blocks(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(sets, pa.binary())], names=["id", "shingles"])

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), bit.alias("bit"))
    return rows.mapInArrow(run, "id long, shingles binary").join(ids, "id", "left_semi").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")
    return joined.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _mixed(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Band rows with the group g each id is in so far, of the bands that still hold several groups."""
    marked = rows.join(groups, "id", "left").withColumn("g", F.coalesce("component", "id")).drop("component")
    mixed = marked.groupBy("band").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("band")
    return marked.join(written(mixed, "mixed"), "band")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _rare_first(shingles: np.ndarray, counters: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles that a linked set must share one of: enough of the rarest that the rest alone could not reach the threshold."""
    common = counters[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)]
    size = len(shingles) - -(-percent * len(shingles) // 100) + 1
    return shingles[np.lexsort((shingles, common))[:size]]


def _rare_pairs(sets: DataFrame, marks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of different groups that share one of their rarest shingles: all that can be linked, and few others.

    Any fixed order of shingles makes this exact. Ordering by how common they are among these documents keeps pairs away
    that share only what many share.
    """

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for s in batch.column(0):
                np.add.at(total, (np.frombuffer(s.as_py(), np.uint64) & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(total[slots], pa.int64())], names=["slot", "c"])

    found = sets.select("shingles").mapInArrow(counting, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    counters = np.zeros(COUNTERS, np.int64)
    counters[found.column("slot").to_numpy()] = found.column("c").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counters)

    def choosing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_of = [np.frombuffer(s.as_py(), np.uint64) for s in batch.column(1)]
            rare = [_rare_first(s, shared.value, percent) for s in sets_of]
            counts = [len(r) for r in rare]
            columns = [np.concatenate([np.zeros(0, np.uint64), *rare]).view(np.int64)]
            columns += [np.repeat(x, counts) for x in (batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), [len(s) for s in sets_of])]
            columns.append(np.concatenate([np.zeros(0, np.int64), *[np.arange(c) for c in counts]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shingle", "id", "g", "n", "i"])

    rows = sets.join(marks, "id").select("id", "shingles", "g").mapInArrow(choosing, "shingle long, id long, g long, n long, i long")
    several = rows.groupBy("shingle").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("shingle")
    rows = written(rows.join(written(several, "several"), "shingle"), "rare")
    other = rows.toDF("shingle", "other", "h", "m", "j")
    # What the two share from this shingle on bounds the intersection, if it is the first they share; later ones bound less.
    most = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    enough = (100 + percent) * most >= percent * (F.col("n") + F.col("m"))
    both = rows.join(other, "shingle").where((F.col("id") > F.col("other")) & (F.col("g") != F.col("h")) & similar_sizes(F.col("n"), F.col("m"), percent) & enough)
    return both.select(*_ordered("id", "other")).distinct()


def link_groups(docs: DataFrame, doc_id: str, text: str, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, component) of the ids of sketches that are linked to another one, directly or not.

    A band's rows are first compared with the one of them that meets most others, which joins most of a large group of
    near copies at a cost in proportion to its rows. What can matter after that are pairs of different
    groups of one band. The documents of such bands are paired by their rarest shingles instead, which finds every link
    between them without a band's rows all meeting each other.
    """
    sparse = sketches.where(F.col("registers").isNotNull())
    rows = bands(sparse)
    several = rows.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    rows = written(rows.join(written(several.select("band", "n"), "several"), "band"), "bands")
    # The row that shares its bands with most others is the likeliest to be what the others were copied from.
    rank = F.struct(F.col("met"), (-F.col("id")).alias("id"))
    met = written(rows.groupBy("id").agg(F.sum("n").alias("met")), "met")
    hubs = rows.join(met, "id").groupBy("band").agg((-F.max(rank)["id"]).alias("hub"))
    rows = rows.select("band", "id")
    stars = rows.join(written(hubs, "hubs"), "band").where("id != hub")
    near = written(only_ids(sparse, met.select("id")), "near")

    def verified(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        hopeful = written(promising(pairs, near, percent), "promising")
        if sets is None:
            ids = written(hopeful.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
            sets = written(full_sets(docs, doc_id, text, ids), "sets")
        return written(confirmed(hopeful, sets, percent), "confirmed")

    links = verified(stars.select(*_ordered("id", "hub")).distinct())
    groups = components(links)
    marks = written(_mixed(rows, groups).select("id", "g").distinct(), "marks")
    sets = written(full_sets(docs, doc_id, text, marks.select("id")), "sets")
    links = links.union(verified(_rare_pairs(sets, marks, percent), sets))
    return components(links)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links) and kept (it is its own).

    Sets of shingles are linked if their Jaccard similarity is percent / 100 or more.
    Words are separated by ASCII white space and compared with A-Z lower-cased. Null, empty and wordless texts have no
    shingles and are linked with nothing. A document without an id is never linked and always kept. An id should stand for
    one text; of rows that share an id each is returned, with the group of one of them. Documents with equal sets are
    collapsed before any band is built.
    """
    sketches = written(sketch(docs, doc_id, text, percent), "sketches")
    named = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = written(named.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    firsts = named.join(sets.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    groups = link_groups(docs, doc_id, text, written(firsts, "firsts"), percent)
    heads = sets.join(groups, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("head"))
    rows = sketches.select("doc_id", "n_shingles", "digest").join(written(heads, "heads"), "digest", "left")
    single = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(single, F.col("doc_id")).otherwise(F.col("head"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
