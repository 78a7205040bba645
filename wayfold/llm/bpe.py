"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece has exactly one last token in the encoding of that prefix. Token t may follow the encoding of the
text before it if merging would never reach over the seam between the last token there and t. So one pass over the
prefixes finds the encoding, appending goes on where the table ends, and an edit recomputes only until the table agrees
with the old one again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import once, release, span_hashes, text_blocks
from wayfold.llm.prefixes import NEVER, Prefixes, Tables
from wayfold.llm.split import match_starts
from wayfold.llm.store import free_names

#: Seams that a Python worker remembers.
SEAMS = 1 << 20
#: Bytes beyond which a piece is encoded apart from others, and beyond which by a table in plain Python.
LONG, VERY_LONG = 256, 1 << 14
#: Bytes of text, and of different pieces, handled at once.
BLOCK, SLICE = 1 << 19, 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file with a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> tuple[list[int], dict[int, tuple[int, int, int]]]:
    """Merge the leftmost pair of the lowest rank until none is left; also (left, right, rank) of each merge made."""
    made = {}
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda k: pairs.get(symbols[k] << 20 | symbols[k + 1], (NEVER, 0))[0])
        rank, new = pairs.get(symbols[best] << 20 | symbols[best + 1], (NEVER, 0))
        if rank == NEVER:
            break
        made[new] = (symbols[best], symbols[best + 1], rank)
        symbols[best : best + 2] = [new]
    return symbols, made


def compile_vocabulary(tokens: dict[bytes, int], symbols: dict[int, list[int]], pairs: dict[int, tuple[int, int]], final: dict[bytes, int] | None = None) -> dict:
    """What encoding needs, as plain values that can be broadcast.

    tokens maps bytes to ids (final: those that must end a word), symbols gives a token's smallest parts, pairs the rank
    and the result of each merge. For both edges of a token it holds the nodes there with the rank that consumes each.
    """
    right: dict[int, list[tuple[int, int]]] = {}
    left: dict[int, list[tuple[int, int]]] = {}
    reachable = set()
    for token, parts in symbols.items():
        whole, made = merged(parts, pairs)
        if whole != [token]:
            continue
        reachable.add(token)
        for edges, side in ((left, 0), (right, 1)):
            node, consumed, edge = token, NEVER, []
            while True:
                edge.append((node, consumed))
                if node not in made:
                    break
                consumed = made[node][2]
                node = made[node][side]
            edges[token] = edge
    keep = lambda d: {k: v for k, v in d.items() if v in reachable}
    lengths: dict[int, set[int]] = {}
    for known in (tokens, final or {}):
        for t, i in known.items():
            if i in reachable:
                lengths.setdefault(t[-1], set()).add(len(t))
    name = hashlib.sha256(repr(sorted(tokens.items())).encode()).hexdigest()
    return {
        "name": name, "tokens": keep(tokens), "final": keep(final) if final is not None else None, "right": right, "left": left,
        "pairs": {k: v[0] for k, v in pairs.items()}, "lengths": {b: sorted(x, reverse=True) for b, x in lengths.items()},
    }


def compile_ranks(ranks: dict[bytes, int]) -> dict:
    """A vocabulary in which any two neighbours whose bytes together are a token merge at its rank."""
    pairs = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                pairs[a << 20 | b] = (rank, rank)
    return compile_vocabulary(ranks, {i: [ranks[bytes([b])] for b in t] for t, i in ranks.items()}, pairs)


def packed(vocabulary: dict) -> dict:
    """A compiled vocabulary as plain arrays, without the dicts: enough for all but very long pieces."""
    return {"name": vocabulary["name"], "final": vocabulary["final"] and True, "arrays": Tables(vocabulary, 16).arrays()}


class PrefixTable:
    """The last token of every prefix of a growing byte string, and the tokens up to it."""

    def __init__(self, vocabulary: dict, piece: bytes = b"", whole_word: bool = False):
        self.vocabulary = vocabulary
        self.seams: dict[int, bool] = once(f"seams {vocabulary['name']}", dict)
        self.piece = b""
        self.last: list[int] = [-1]
        self.sizes: list[int] = [0]
        self.counts: list[int] = [0]
        if piece:
            self._extend(piece, whole_word)

    def fits(self, before: int, token: int) -> bool:
        """True if no merge joins a node at the right edge of before with one at the left edge of token in time."""
        key = before << 20 | token
        known = self.seams.get(key)
        if known is None:
            pairs, known = self.vocabulary["pairs"], True
            for x, x_end in self.vocabulary["right"][before]:
                for y, y_end in self.vocabulary["left"][token]:
                    rank = pairs.get(x << 20 | y)
                    if rank is not None and rank < x_end and rank <= y_end:
                        known = False
                        break
                if not known:
                    break
            if len(self.seams) >= SEAMS:
                self.seams.clear()
            self.seams[key] = known
        return known

    def _step(self, piece: bytes, end: int, tokens: dict[bytes, int]) -> None:
        last = self.last
        for size in self.vocabulary["lengths"].get(piece[end - 1], ()):
            if size > end:
                continue
            token = tokens.get(piece[end - size : end])
            if token is not None and (size == end or last[end - size] >= 0 and self.fits(last[end - size], token)):
                last.append(token)
                self.sizes.append(size)
                self.counts.append(self.counts[end - size] + 1)
                return
        last.append(-1)
        self.sizes.append(0)
        self.counts.append(0)

    def _extend(self, more: bytes, whole_word: bool = False) -> None:
        piece = self.piece + more
        tokens, final = self.vocabulary["tokens"], self.vocabulary["final"]
        for end in range(len(self.piece) + 1, len(piece) + 1):
            self._step(piece, end, final if whole_word and end == len(piece) else tokens)
        self.piece = piece

    def append(self, more: bytes) -> None:
        """Go on with more bytes; the table so far stays valid."""
        self._extend(more)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put new in place of the bytes start to stop; returns how many prefixes were computed anew.

        A prefix depends on no more bytes and entries than the longest token has. Once as many entries in a row beyond the
        edit equal the old ones, all further ones do too.
        """
        old_last, old_sizes, old_counts, old = self.last, self.sizes, self.counts, self.piece
        piece = old[:start] + new + old[stop:]
        shift = len(new) - (stop - start)
        reach = max((x[0] for x in self.vocabulary["lengths"].values()), default=1)
        self.last, self.sizes, self.counts = old_last[: start + 1], old_sizes[: start + 1], old_counts[: start + 1]
        same = computed = 0
        for end in range(start + 1, len(piece) + 1):
            if same >= reach and end - reach > start + len(new):
                keep, gone = end - shift, self.counts[-1] - old_counts[end - 1 - shift]
                self.last += old_last[keep:]
                self.sizes += old_sizes[keep:]
                # Counts in the agreeing stretch may differ from one another by path, so follow the sizes.
                if gone or any(self.counts[end - k] - old_counts[end - k - shift] != gone for k in range(1, reach + 1)):
                    for e in range(end, len(piece) + 1):
                        self.counts.append(self.counts[e - self.sizes[e]] + 1)
                else:
                    self.counts += old_counts[keep:]
                break
            self._step(piece, end, self.vocabulary["tokens"])
            computed += 1
            agrees = end > start + len(new) and self.last[end] == old_last[end - shift]
            same = same + 1 if agrees else 0
        self.piece = piece
        return computed

    def ids(self) -> list[int]:
        out, end = [], len(self.piece)
        while end:
            if self.last[end] < 0:
                raise ValueError(f"no token ends at byte {end}")
            out.append(self.last[end])
            end -= self.sizes[end]
        return out[::-1]


def ranges(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of so many values from each start, one after another."""
    ends = np.cumsum(sizes)
    index = np.arange(ends[-1] if len(ends) else 0)
    index += np.repeat(starts - (ends - sizes), sizes)
    return values[index]


def expand(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ranges bounds[w] up to bounds[w + 1] of values for each w in which, one after another."""
    return ranges(values, bounds[which], (bounds[1:] - bounds[:-1])[which])


def distinct_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One position of each distinct piece, and for every piece which of these it equals."""
    _, where, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return where, which


def encode_block(data: np.ndarray, offsets: np.ndarray, encode_new) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a block, and where each text's ids start (and the last ones end).

    Each distinct piece is encoded once; encode_new turns joined pieces and their bounds into ids and their bounds.
    """
    starts = match_starts(data, offsets)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    where, which = distinct_pieces(data, starts, ends)
    sizes = (ends - starts)[where]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat, found = encode_new(ranges(data, starts[where], sizes), bounds)
    ids = expand(flat, found, which)
    upto = np.concatenate([[0], np.cumsum(np.diff(found)[which])]).astype(np.int64)
    return ids, upto[np.searchsorted(starts, offsets)]


def encode_pieces(vocabulary: dict, data: np.ndarray, bounds: np.ndarray, whole=None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of joined pieces by their prefix tables, a bounded stretch of them at a time; a long piece goes alone.

    whole gives the vocabulary with its dicts, wanted for very long pieces alone; without it, vocabulary has them.
    """
    sizes = np.diff(bounds)
    lone = np.flatnonzero(sizes > LONG)
    cuts = {0, len(sizes), *lone.tolist(), *(lone + 1).tolist()}
    cuts.update(np.searchsorted(bounds, np.arange(SLICE, bounds[-1], SLICE)).tolist())
    cuts, flat, counts = sorted(cuts), [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = data[bounds[a] : bounds[b]]
        if len(part) > VERY_LONG and b == a + 1:
            flat.append(np.array(PrefixTable(whole() if whole else vocabulary, part.tobytes()).ids(), np.int64))
            counts.append([len(flat[-1])])
        else:
            ids, found = Prefixes(vocabulary, part, bounds[a : b + 1] - bounds[a]).ids()
            flat.append(ids.astype(np.int32))
            counts.append(np.diff(found))
    return np.concatenate([*flat, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(np.concatenate([*counts, []]))]).astype(np.int64)


class Decoder:
    """Bytes of ids, for many ids at once."""

    def __init__(self, tokens: dict[int, bytes]):
        top = max(tokens, default=-1)
        sizes = np.array([len(tokens.get(i, b"")) for i in range(top + 1)], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.flat = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(top + 1)), np.uint8)

    @classmethod
    def of(cls, bounds: np.ndarray, flat: np.ndarray) -> Decoder:
        decoder = cls.__new__(cls)
        decoder.bounds, decoder.flat = bounds, flat
        return decoder

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return expand(self.flat, self.bounds, ids)

    def bounds_of(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum((self.bounds[1:] - self.bounds[:-1])[ids])])


def _quoted(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(
    docs: DataFrame, ranks: dict[bytes, int], *, text: str = "text", ids: str = "ids", keep: list[str] | None = None, decoded: str | None = None, restored: str | None = None
) -> DataFrame:
    """The columns keep (all by default) with a column of token ids. If decoded names a column, it has the bytes of these
    ids; if restored does, it says whether these are the bytes of the text, compared where they are made.

    A null or empty text has no ids; repeated rows are encoded row by row. A name that keep has already gets underscores
    at its end, so the columns of keep stay as they are; the new columns are the last ones, in the order ids, decoded, restored.
    """
    spark, keep = docs.sparkSession, docs.columns if keep is None else keep
    vocabulary = compile_ranks(ranks)
    decoder = Decoder({i: t for t, i in vocabulary["tokens"].items()})
    shared = spark.sparkContext.broadcast(packed(vocabulary) | {"decoder": (decoder.bounds, decoder.flat)})
    raw_ranks = spark.sparkContext.broadcast(ranks)
    new = [ids, *([decoded] if decoded else []), *([restored] if restored else [])]
    names = [*keep, *free_names(new, keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = shared.value
        own = f"tables {small['name']}", f"dicts {small['name']}", f"seams {small['name']}", "character kinds"
        release(*own)
        decoder = Decoder.of(*small["decoder"])
        whole = lambda: once(own[1], lambda: compile_ranks(raw_ranks.value))
        for batch in batches:
            kept, texts = batch.select(batch.schema.names[: len(keep)]), batch.column(batch.num_columns - 1)
            for first, last, data, offsets in text_blocks(texts, BLOCK):
                found, bounds = encode_block(data, offsets, lambda new, at: encode_pieces(small, new, at, whole))
                columns = [*kept.slice(first, last - first).columns]
                columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found.astype(np.int32))))
                if decoded or restored:
                    raw = decoder.decode(found)
                    at = decoder.bounds_of(found)[bounds]
                if decoded:
                    columns.append(pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)]))
                if restored:
                    columns.append(pa.array(same_texts(raw, at, data, offsets)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    kinds = [f.dataType.simpleString() for f in docs.select(*[f"`{c}`" for c in keep]).schema]
    kinds += ["array<int>", *["binary"] * bool(decoded), *["boolean"] * bool(restored)]
    return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def same_texts(raw: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text of a block whether the bytes raw, bounded by at, equal its own."""
    same = np.diff(at) == np.diff(offsets)
    if same.all():
        wrong = np.concatenate([[0], np.cumsum(raw != data)])
        return wrong[offsets[1:]] == wrong[offsets[:-1]]
    for k in np.flatnonzero(same).tolist():
        same[k] = np.array_equal(raw[at[k] : at[k + 1]], data[offsets[k] : offsets[k + 1]])
    return same


def decode(docs: DataFrame, ranks: dict[bytes, int], *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with a binary column of the bytes of their ids, its name with underscores added if docs has it already.

    Null ids decode to no bytes; an unknown id is an error.
    """
    decoded = free_names([decoded], docs.columns)[0]
    shared = docs.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            sizes = np.concatenate([[0], [0 if n is None else n for n in column.value_lengths().to_pylist()]]).astype(np.int64)
            bounds, values, flat = np.cumsum(sizes), [], column.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (int(flat.max()) >= len(decoder.bounds) - 1 or int(flat.min()) < 0):
                raise ValueError("an id that the vocabulary does not have")
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                values.append(decoder.decode(flat[a:b]).tobytes())
            columns = [*batch.columns, pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, decoded])

    return docs.mapInArrow(run, f"{_quoted(docs)}, `{decoded}` binary")


def ids_text(ids: F.Column) -> F.Column:
    """Decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")
