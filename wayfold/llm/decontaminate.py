"""Benchmark decontamination: hashed n-gram windows of the test items, looked up in every training text.

The windows of the benchmark are broadcast in blocks of bounded size. Each training text is scanned once per block;
a window whose hash occurs is compared word by word before it counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import ALNUM, Words, text_blocks
from wayfold.llm.store import free_names, written

#: Words in a window.
WINDOW = 10
#: Bytes of benchmark text whose windows are broadcast at once; a larger benchmark is scanned in several passes.
BLOCK = 32 << 20
FILTER_BITS = 20

HITS = "n_words long, spans array<struct<first:long,size:int>>, items array<string>"


def window_set(rows: list[tuple], window: int = WINDOW) -> dict:
    """Sorted window hashes of the items and, for each, its number of words, the words and the items that hold it."""
    found: dict[tuple[int, int, bytes], set[str]] = {}
    texts = [(str(item), (text or "").encode()) for item, text in rows]
    data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in texts], dtype=np.int64)]).astype(np.int64)
    words = Words(data, offsets, ALNUM, fold=True)
    sizes = np.minimum(np.diff(words.first), window)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at, hashes = words.windows(size)
        owner = words.texts()[at]
        for a, h, o in zip(at.tolist(), hashes.tolist(), owner.tolist()):
            if sizes[o] == size:
                found.setdefault((h, size, words.joined(a, size)), set()).add(texts[o][0])
    keys = sorted(found)
    hashes = np.array([k[0] for k in keys], np.uint64)
    present = np.zeros(1 << FILTER_BITS, bool)
    present[hashes >> np.uint64(64 - FILTER_BITS)] = True
    return {
        "hashes": hashes, "sizes": [k[1] for k in keys], "words": [k[2] for k in keys],
        "items": [sorted(found[k]) for k in keys], "present": present,
    }


def scan(known: dict, words: Words) -> list[tuple[int, int, list[str]]]:
    """(first word, words, items) of every verified occurrence of a known window."""
    hits = []
    for size in sorted(set(known["sizes"])):
        at, hashes = words.windows(size)
        maybe = np.flatnonzero(known["present"][hashes >> np.uint64(64 - FILTER_BITS)])
        low = np.searchsorted(known["hashes"], hashes[maybe], "left")
        high = np.searchsorted(known["hashes"], hashes[maybe], "right")
        for a, i, j in zip(at[maybe[high > low]].tolist(), low[high > low].tolist(), high[high > low].tolist()):
            here = words.joined(a, size)
            hits += [(a, size, known["items"][k]) for k in range(i, j) if known["sizes"][k] == size and known["words"][k] == here]
    return hits


def _scan_batches(batches: Iterator[pa.RecordBatch], known, text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        counts, spans, items = [], [], []
        for _, _, data, offsets in text_blocks(column):
            words = Words(data, offsets, ALNUM, fold=True)
            counts.append(np.diff(words.first))
            found: list = [[] for _ in range(len(offsets) - 1)]
            names: list = [set() for _ in range(len(offsets) - 1)]
            hits = scan(known.value, words)
            owner = np.searchsorted(words.first, [h[0] for h in hits], "right") - 1
            for t, (first, size, ids) in zip(owner.tolist(), hits):
                found[t].append({"first": first - int(words.first[t]), "size": size})
                names[t].update(ids)
            spans += found
            items += [sorted(x) for x in names]
        kind = pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int32())]))
        n_words = pa.array(np.concatenate(counts) if counts else [], pa.int64())
        new = [n_words, pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "n_words", "spans", "items"])


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, block: int) -> Iterator[list[tuple]]:
    """The items in blocks of about so many bytes of text, each small enough for the driver and a broadcast."""
    sized = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = sized.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    pieces = max(1, -(-2 * total // block)) if total > block else 1
    for piece in range(pieces):
        part = sized if pieces == 1 else sized.where(F.pmod(F.xxhash64("item"), F.lit(pieces)) == piece)
        yield [(r["item"], r["text"]) for r in part.collect()]


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, *, keep: list[str], text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """One row per document: the columns keep, n_words, spans and items.

    spans are the verified occurrences of item windows, as first word and number of words; items the ids (as strings,
    sorted) of the items they belong to. An item of fewer words than the window is one window. Null and wordless texts,
    on either side, never hit. Repeated documents and items are judged row by row; ids may be null or repeat. The three
    come last; one whose name keep has already gets underscores at its end, and keep's column stays as it is.
    """
    spark = docs.sparkSession
    rows = docs.select([F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)] + [F.col(text).alias("_text")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = None
    for number, part in enumerate(benchmark_blocks(benchmark, item, item_text, block)):
        known = spark.sparkContext.broadcast(window_set(part, window))
        if out is None:
            out = rows.mapInArrow(lambda it, known=known: _scan_batches(it, known, "_text"), f"{schema}, {HITS}")
            continue
        # A further block adds its spans and items to those written so far.
        sofar = written(out.withColumnsRenamed({"n_words": "_n", "spans": "_spans", "items": "_items"}), f"overlaps{number}")
        wide = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sofar.schema)
        out = sofar.mapInArrow(lambda it, known=known: _scan_batches(it, known, "_text"), f"{wide}, {HITS}")
        out = out.withColumns({
            "spans": F.concat("_spans", "spans"), "items": F.array_sort(F.array_distinct(F.concat("_items", "items"))),
        }).drop("_n", "_spans", "_items")
    return out.drop("_text").toDF(*keep, *free_names(["n_words", "spans", "items"], keep))


def covered_words(spans: F.Column) -> F.Column:
    """Number of words inside any span."""
    step = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["first"] + s["size"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["first"] + s["size"] - F.greatest(acc["end"], s["first"]))).alias("n"),
        ),
    )
    return step["n"]


def _cut(text: str | None, spans: list | None) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not text or not spans:
        return text
    data = np.frombuffer(text.encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]), ALNUM, fold=True)
    hit = np.zeros(len(words) + 1, bool)
    for s in spans:
        hit[s["first"] : s["first"] + s["size"]] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit[:-1], [False]]).astype(np.int8)))
    out, at = [], 0
    for a, b in edges.reshape(-1, 2).tolist():
        out.append(data[at : words.starts[a]].tobytes())
        at = int(words.ends[b - 1])
    return b"".join([*out, data[at:].tobytes()]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """docs without benchmark passages: "documents" drops each document that holds one, "spans" cuts the passages out.

    The columns of docs are kept as they are; see find_overlaps for nulls, ties and repeats.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    body = f"_c{names.index(text)}"
    found = find_overlaps(inner, benchmark, keep=inner.columns, text=body, **options)
    if remove == "documents":
        kept = found.where(F.size("items") == 0)
    else:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema)

        columns_in = inner.columns

        def cut(batches):
            for batch in batches:
                at = batch.schema.get_field_index(body)
                texts, spans = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                columns = [batch.column(c) for c in columns_in]
                columns[at] = pa.array([_cut(t, s) for t, s in zip(texts, spans)], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=columns_in)

        kept = found.select(*inner.columns, "spans").mapInArrow(cut, kinds)
    return kept.select([F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])
