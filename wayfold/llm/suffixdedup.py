"""Removal of repeated passages by sorting suffixes, one bucket at a time, with the ranks of a difference cover for ties.

A window is a string of `length` bytes. Its mark, the least hash of its 32-byte grams, says in which bucket it is sorted,
so equal windows meet whichever documents they come from. Neighbouring windows of a mark travel together as one stretch
of text. Stretches of a mark found once hold nothing repeated, and of equal stretches only the first is sorted. The suffixes
of a bucket are ordered by their first words; those that still tie are told apart by the precomputed ranks of suffixes at
the positions of a difference cover, which any two suffixes reach at one common distance. Memory is a bucket's, however
large the corpus or long the ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.arrays import BASE, mix, once, release, runs, span_hashes, text_blocks
from wayfold.llm.store import free_names, written

LENGTH = 100
#: Bytes of a gram; a window's mark is the least hash of its grams.
GRAM = 32
#: Bytes of text marked at once, and bytes of stretches sorted at once.
PIECE, BUCKET = 1 << 19, 1 << 21
#: Different stretches of a mark beyond which its windows are combined by digest first instead of sorted in one task.
HOT = 4096
#: Residues modulo COVER whose differences give every distance.
COVER, RESIDUES = 31, (1, 5, 11, 24, 25, 27)
WORD = 8
STRETCH = "_mark long, _same long, _id long, _start long, _windows int"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position, by doubling; the last positions that have fewer are left out."""
    values = once("gram bytes", lambda: mix(np.arange(1, 257, dtype=np.uint64) * BASE))[data]
    size = 1
    while size < GRAM:
        if len(values) <= size:
            return np.zeros(0, np.uint64)
        power = np.uint64(pow(int(BASE), size, 1 << 64))
        values = values[:-size] * power + values[size:]
        size *= 2
    return mix(values)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the width values from each position on: least so far within fixed blocks, from both sides."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.uint64(2**64 - 1))
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[:count], upto[width - 1 : width - 1 + count])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Mark, hash of the text, first byte and number of windows of each run of windows with one mark; the number is
    negative if the mark's gram occurs in it more than once, as it must where a window comes again in its own run."""
    grams, reach = gram_hashes(data), length - GRAM + 1
    marks = least_of(grams, reach)
    sizes = np.diff(offsets)
    # A window is one only if it ends in the text it starts in.
    inside = np.repeat(offsets[1:], sizes)[: len(marks)] - np.arange(len(marks)) >= length
    same = np.zeros(len(marks), bool)
    same[1:] = (marks[1:] == marks[:-1]) & inside[:-1]
    # Where one text's windows end the next text's start is far, so neighbours of a run are of one text.
    first = np.flatnonzero(inside & ~same)
    breaks = np.flatnonzero(~inside)
    stop = np.minimum(np.append(first[1:], len(marks)), np.append(breaks, len(marks))[np.searchsorted(breaks, first)])
    # Grams that are the mark of some window: as great as the greatest mark of the windows around them.
    around = np.concatenate([np.full(reach - 1, 2**64 - 1, np.uint64), ~marks, np.full(reach - 1, 2**64 - 1, np.uint64)])
    peaks = np.flatnonzero(grams[: len(marks) + reach - 1] == ~least_of(around, reach))
    low, high = np.searchsorted(peaks, first), np.searchsorted(peaks, stop + reach - 1)
    owner = np.repeat(np.arange(len(first)), high - low)
    inner = peaks[np.arange(len(owner)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]
    times = np.bincount(owner[grams[inner] == marks[first][owner]], minlength=len(first))
    windows = np.where(times > 1, first - stop, stop - first)
    return marks[first].view(np.int64), span_hashes(data, first, stop - 1 + length).view(np.int64), first, windows


def _marked(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    release("gram bytes")
    for batch in batches:
        ids, bases = (batch.column(k).to_numpy() for k in (0, 1))
        for a, b, data, offsets in text_blocks(batch.column(2), PIECE):
            at = 0
            while at < len(data):
                # One text longer than a piece is cut; a piece takes along what its last windows need.
                end = len(data) if len(data) - at <= 2 * PIECE else at + PIECE
                piece = data[at : min(len(data), end + length - 1)]
                bounds = np.clip(offsets, at, at + len(piece)) - at
                marks, same, first, windows = stretches(piece, bounds, length)
                text = np.searchsorted(offsets, first + at, "right") - 1
                columns = [marks, same, ids[a:b][text], bases[a:b][text] + first + at - offsets[text], windows.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_mark", "_same", "_id", "_start", "_windows"])
                at = end


def _sieved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of stretches sorted by (mark, text, id, start): those that repeat an earlier one (_copy), and the first of each text
    if its mark has several texts or comes in it more than once."""
    held: list[np.ndarray] | None = None  # a mark's first stretch that goes out once another text of the mark comes
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        twice, columns[4] = columns[4] < 0, np.abs(columns[4])
        before = [np.concatenate([[0 if last is None else last[k]], c[:-1]]) for k, c in enumerate(columns[:4])]
        equal = [c == p for c, p in zip(columns[:4], before)]
        if last is None:
            equal[0][0] = False
        last = [c[-1] for c in columns[:4]]
        known_text = equal[0] & equal[1]
        copy = known_text & ~(equal[2] & equal[3])  # a row that comes twice is no copy of itself
        new = ~known_text
        at = np.flatnonzero(new)
        opens = ~equal[0][at]
        # Every text of a mark but its first shows that the mark has several; the first goes out once a second is seen.
        out = [c[at[~opens | twice[at]]] for c in columns]
        group = np.cumsum(opens)
        several = np.zeros(int(group[-1]) + 1 if len(group) else 1, bool)
        several[group[~opens]] = True
        firsts = at[opens][several[1:]]
        firsts = firsts[~twice[firsts]]
        parts = [[c[firsts] for c in columns], out]
        if held is not None and several[0]:
            parts.append([np.array([x]) for x in held])
        if several[0]:
            held = None
        if opens.any():
            row = at[opens][-1]
            held = None if several[-1] or twice[row] else [c[row] for c in columns]
        found = [np.concatenate(x) for x in zip(*parts)]
        copies = [c[copy] for c in columns]
        flags = np.concatenate([np.zeros(len(found[0]), bool), np.ones(len(copies[0]), bool)])
        arrays = [pa.array(np.concatenate(x)) for x in zip(found, copies)]
        if len(flags):
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(flags)], names=["_mark", "_same", "_id", "_start", "_windows", "_copy"])


class Suffixes:
    """Windows of a bucket in the order of their bytes. text: the stretches, one after another, each with whole windows."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, length: int):
        self.length = length
        padded = np.concatenate([text, np.zeros(2 * length + COVER, np.uint8)]).astype(np.uint64)
        two = padded[:-1] << np.uint64(8) | padded[1:]
        four = two[:-2] << np.uint64(16) | two[2:]
        self.words = four[:-4] << np.uint64(32) | four[4:]
        self.starts, self.size = starts, len(text)
        self.cover = np.zeros(COVER, bool)
        self.cover[list(RESIDUES)] = True
        # distance[a, b]: how far from positions of these residues both reach the cover.
        reach = np.arange(COVER)[:, None] + np.arange(COVER)[None]
        hits = self.cover[reach % COVER]
        self.distance = np.argmax(hits[:, None] & hits[None], axis=2)

    def refined(self, at: np.ndarray, group: np.ndarray, depth: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions that are in groups, sorted within these by `depth` bytes from `first` on; groups of those that tie."""
        live = np.arange(len(at))
        for skip in range(first, depth, WORD):
            key = self.words[at[live] + min(skip, max(depth - WORD, 0))]
            order = np.argsort(key, kind="stable") if skip == 0 and first == 0 else np.lexsort((key, group[live]))
            at[live] = at[live][order]
            key = key[order]
            g = group[live]  # unchanged by the sort: the groups' ranges stay
            cut = np.ones(len(live), bool)
            cut[1:] = (key[1:] != key[:-1]) | (g[1:] != g[:-1])
            head = live[np.flatnonzero(cut)]
            group[live] = head[np.cumsum(cut) - 1]
            size = np.diff(np.append(np.flatnonzero(cut), len(live)))
            live = live[np.repeat(size > 1, size)]
            if not len(live):
                break
        return at, group

    def cover_ranks(self) -> np.ndarray:
        """For each position of the cover, the rank of the bytes from there on that a window can reach."""
        at = np.flatnonzero(self.cover[np.arange(self.size) % COVER])
        at, group = self.refined(at, np.zeros(len(at), np.int64), self.length)
        ranks = np.zeros(self.size + COVER, np.int64)
        ranks[at] = group
        return ranks

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """All windows in sorted order, and where in it a window differs from the one before."""
        depth = -(-COVER // WORD) * WORD
        at, group = self.refined(self.starts.copy(), np.zeros(len(self.starts), np.int64), min(depth, self.length))
        live = self._several(np.arange(len(at)), group)
        if len(live):
            ranks = self.cover_ranks()
        while len(live):
            # Each group parts in those before its pivot, equal to it and after it; the equal ones are done.
            g = group[live]
            begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            size = np.diff(np.append(begin, len(live)))
            pivot = np.repeat(at[live[begin + size // 2]], size)
            here = at[live]
            far = self.distance[here % COVER, pivot % COVER]
            side = np.sign(ranks[here + far] - ranks[pivot + far])
            order = np.lexsort((side, g))
            at[live] = here[order]
            side = side[order]
            cut = np.concatenate([[True], (g[1:] != g[:-1]) | (side[1:] != side[:-1])])
            group[live] = live[np.flatnonzero(cut)][np.cumsum(cut) - 1]
            size = np.diff(np.append(np.flatnonzero(cut), len(live)))
            live = live[np.repeat(size > 1, size) & (side != 0)]
        differs = np.ones(len(at), bool)
        same = at[1:], at[:-1]
        close = np.flatnonzero(self.words[same[0]] == self.words[same[1]])
        for skip in range(WORD, self.length, WORD):
            skip = min(skip, self.length - WORD)
            close = close[self.words[same[0][close] + skip] == self.words[same[1][close] + skip]]
        differs[close + 1] = False
        return at, differs

    def _several(self, live: np.ndarray, group: np.ndarray) -> np.ndarray:
        if not len(live):
            return live
        g = group[live]
        size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), len(live)))
        return live[np.repeat(size > 1, size)]


def later_windows(text: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """Whether the window at each byte of joined stretches also starts at an earlier byte; False where there is no window."""
    sizes = np.diff(bounds)
    room = np.repeat(bounds[1:], sizes) - np.arange(len(text)) >= length
    order, differs = Suffixes(text, np.flatnonzero(room), length).classes()
    later = np.zeros(len(text), bool)
    if len(order):
        begin = np.flatnonzero(differs)
        first = np.repeat(np.minimum.reduceat(order, begin), np.diff(np.append(begin, len(order))))
        later[order] = order != first
    return later


def _sorted_buckets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(_id, _start, _windows) of the repeated windows, from stretches (mark, id, start, bytes) sorted by mark."""
    parts, size, last = [], 0, None

    def settled(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, starts = (table.column(k).to_numpy() for k in (1, 2))
        order = np.lexsort((starts, ids))  # so that the earlier of two windows has the smaller place
        once_more = np.zeros(len(order), bool)  # a row of the table that comes twice
        once_more[1:] = (ids[order][1:] == ids[order][:-1]) & (starts[order][1:] == starts[order][:-1])
        order = order[~once_more]
        body = table.column(3).take(pa.array(order)).combine_chunks().cast(pa.large_binary())
        _, where, raw = body.buffers()
        bounds = np.frombuffer(where, np.int64, len(body) + 1, body.offset * 8)
        text = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        a, b = runs(later_windows(text, bounds, length), bounds)
        which = np.searchsorted(bounds, a, "right") - 1
        columns = ids[order][which], starts[order][which] + a - bounds[which], (b - a).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_id", "_start", "_windows"])

    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = batch.column(0).to_numpy()
        sizes = np.diff(np.frombuffer(batch.column(3).cast(pa.large_binary()).buffers()[1], np.int64, batch.num_rows + 1, batch.column(3).offset * 8))
        opens = np.concatenate([[last is None or marks[0] != last], marks[1:] != marks[:-1]])
        last, done, upto = marks[-1], 0, np.concatenate([[0], np.cumsum(sizes)])
        for k in np.flatnonzero(opens).tolist():
            if size + upto[k] - upto[done] >= BUCKET:
                if k > done:
                    parts.append(batch.slice(done, k - done))
                yield settled(parts)
                parts, size, done = [], 0, k
        parts.append(batch.slice(done))
        size += int(upto[-1] - upto[done])
    if parts:
        yield settled(parts)


def _placed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with _id, _text and _base, the bytes before the row in its document: 0 but for rows that share an id."""
    rows = docs.withColumns({"_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))), "_text": F.coalesce(F.col(text), F.lit("")).cast("binary")})
    shared = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id")
    if shared.isEmpty():
        return rows.withColumn("_base", F.lit(0).cast("long"))
    digest = F.sha2("_text", 256).alias("_digest")
    texts = rows.join(shared, "_id", "left_semi").select("_id", digest, F.octet_length("_text").alias("n")).distinct()
    before = Window.partitionBy("_id").orderBy("_digest").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(texts.select("_id", "_digest", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("_base")), "bases")
    return rows.withColumn("_digest", digest).join(bases, ["_id", "_digest"], "left").drop("_digest").fillna(0, ["_base"])


def repeated_windows(rows: DataFrame, length: int) -> DataFrame:
    """(_id, _start, _windows): runs of windows that also start earlier, from rows as _placed gives them."""
    read = rows.select("_id", "_base", "_text").where(F.octet_length("_text") >= length)
    marked = read.mapInArrow(lambda it: _marked(it, length), STRETCH)
    sieved = marked.repartition("_mark").sortWithinPartitions("_mark", "_same", "_id", "_start").mapInArrow(_sieved, f"{STRETCH}, _copy boolean")
    sieved = written(sieved, "stretches")
    copies = sieved.where("_copy").select("_id", "_start", "_windows")
    # The text of the stretches to sort, cut from the documents; a hot mark's windows go by digest.
    wanted = sieved.where("NOT _copy").select("_mark", "_id", "_start", "_windows")
    hot = written(wanted.groupBy("_mark").count().where(F.col("count") > HOT).select("_mark", F.lit(True).alias("_hot")), "hot")
    wanted = wanted.join(hot, "_mark", "left").groupBy("_id").agg(F.collect_list(F.struct("_mark", "_start", "_windows", F.coalesce("_hot", F.lit(False)).alias("_hot"))).alias("_s"))
    found = read.join(wanted, "_id").where("_text IS NOT NULL")
    cut = found.select("_id", "_base", "_text", F.explode("_s").alias("s")).where(
        (F.col("s._start") >= F.col("_base")) & (F.col("s._start") < F.col("_base") + F.octet_length("_text"))
    )
    body = F.substring("_text", (F.col("s._start") - F.col("_base") + 1).cast("int"), F.col("s._windows") + (length - 1))
    cut = written(cut.select("s._mark", "_id", "s._start", body.alias("_body"), "s._hot"), "bodies")
    cold = cut.where("NOT _hot").select("_mark", "_id", "_start", "_body").repartition("_mark").sortWithinPartitions("_mark")
    kinds = "_id long, _start long, _windows int"
    out = copies.unionByName(cold.mapInArrow(lambda it: _sorted_buckets(it, length), kinds))
    if hot.isEmpty():
        return out
    windows = cut.where("_hot").select("_id", "_start", F.explode(F.sequence(F.lit(0), F.octet_length("_body") - length)).alias("k"), "_body")
    digest = F.unhex(F.sha2(F.substring("_body", F.col("k") + 1, F.lit(length)), 256))
    windows = written(windows.select("_id", (F.col("_start") + F.col("k")).alias("_start"), digest.alias("_digest")), "windows")
    first = windows.groupBy("_digest").agg(F.min(F.struct("_id", "_start")).alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("_digest", "_first")
    later = windows.join(first, "_digest").where(F.struct("_id", "_start") != F.col("_first"))
    return out.unionByName(later.select("_id", "_start", F.lit(1).alias("_windows")))


def find_repeats(docs: DataFrame, *, keep: list[str], doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The columns keep with n_bytes, spans (first byte and size of each maximal removed run) and kept (the other bytes).

    A byte goes if a string of `length` bytes (at least GRAM) that covers it also starts earlier, in a smaller id or before
    in the same text. Null and empty texts, and texts shorter than that, lose nothing. Rows without an id come before all
    others; rows that share an id come one after another in the order of their texts' digests, and rows with equal id and
    text are one document. An empty table gives no rows. The three columns come last; one whose name keep has gets
    underscores at its end. kept is binary, since a cut may part the bytes of a character.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    rows = _placed(docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(doc_id).alias("_d"), F.col(text).alias("_t")), "_d", "_t")
    runs_found = written(repeated_windows(rows, length), "repeats")
    by_doc = runs_found.groupBy("_id").agg(F.collect_list(F.struct("_start", "_windows")).alias("_runs"))
    kept = [f"_k{i}" for i in range(len(keep))]
    rows = rows.join(by_doc, "_id", "left").select(*kept, "_base", "_runs", "_text")
    spans = pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bases, found = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1)
            bodies, cuts, sizes = [], [], []
            for k in range(n):
                raw = batch.column(len(kept) + 2)[k].as_buffer()
                data = np.frombuffer(raw, np.uint8) if raw.size else np.zeros(0, np.uint8)
                sizes.append(len(data))
                edges = np.zeros(0, np.int64)
                if found[k].is_valid:
                    first, windows = (x.to_numpy() for x in found[k].values.flatten())
                    edges = removed_edges(first - bases[k], windows, len(data), length)
                cuts.append([{"first": a, "size": b - a} for a, b in edges.reshape(-1, 2).tolist()])
                pieces = np.split(data, edges)[::2] if len(edges) else [data]
                bodies.append(b"".join(p.tobytes() for p in pieces))
            new = [pa.array(sizes, pa.int64()), pa.array(cuts, spans), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names=[*kept, "n_bytes", "spans", "kept"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(kept)]]
    out = rows.mapInArrow(run, ", ".join([*kinds, "n_bytes long", "spans array<struct<first:bigint,size:bigint>>", "kept binary"]))
    return out.toDF(*keep, *free_names(["n_bytes", "spans", "kept"], keep))


def removed_edges(first: np.ndarray, windows: np.ndarray, size: int, length: int) -> np.ndarray:
    """Starts and ends, in turn, of the bytes that runs of windows cover; runs that are not of this text are left out."""
    here = (first >= 0) & (first < size)
    depth = np.zeros(size + 1, np.int64)
    np.add.at(depth, first[here], 1)
    np.add.at(depth, first[here] + windows[here] - 1 + length, -1)
    covered = np.cumsum(depth)[:size] > 0
    return np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
