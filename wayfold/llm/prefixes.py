"""The prefix tables of many pieces at once, as numpy arrays.

Entry e of a piece's table is the last token of its first e bytes. All pieces advance together, one prefix length at a
time; which tokens end where comes from one walk of a trie over all positions.
"""

from __future__ import annotations

import numpy as np

from wayfold.llm.arrays import mix, once

NEVER = 1 << 40


class HashTable:
    """Open addressing from non-negative 64-bit keys to 32-bit values, many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, slots: int = 0):
        bits = max(2 * len(keys), slots, 16).bit_length()
        self.keys, self.values, self.size = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), 0
        self.insert(keys, values)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, int]:
        return self.keys, self.values, self.size

    @classmethod
    def of(cls, arrays: tuple[np.ndarray, np.ndarray, int]) -> HashTable:
        table = cls.__new__(cls)
        table.keys, table.values, table.size = arrays
        return table

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys, each new and different from the others."""
        slots, left = self._slots(keys), np.arange(len(keys))
        self.size += len(keys)
        while len(left):
            free = self.keys[slots[left]] == -1
            self.keys[slots[left[free]]] = keys[left[free]]
            stored = self.keys[slots[left]] == keys[left]
            self.values[slots[left[stored]]] = values[left[stored]]
            left = left[~stored]
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray, missing: int = -1) -> np.ndarray:
        slots = self._slots(keys)
        found = np.full(len(keys), missing, np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[slots[left]]
            hit = there == keys[left]
            found[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (there != -1)]
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
        return found


def _spines(edges: dict[int, list[tuple[int, int]]], top: int) -> tuple[np.ndarray, np.ndarray]:
    depth = max((len(e) for e in edges.values()), default=1)
    nodes, ends = np.full((top, depth), -1, np.int32), np.zeros((top, depth), np.int64)
    for token, edge in edges.items():
        nodes[token, : len(edge)] = [n for n, _ in edge]
        ends[token, : len(edge)] = [c for _, c in edge]
    return nodes, ends


class Tables:
    """Array forms of a compiled vocabulary; see bpe.compile_vocabulary."""

    def __init__(self, vocabulary: dict, seams: int):
        edges: dict[int, int] = {}
        self.token_at, self.final_at = [-1], [-1]
        for known, at in ((vocabulary["tokens"], self.token_at), (vocabulary["final"] or {}, self.final_at)):
            for token, number in known.items():
                node = 0
                for b in token:
                    key = node << 8 | b
                    if key not in edges:
                        edges[key] = len(self.token_at)
                        self.token_at.append(-1)
                        self.final_at.append(-1)
                    node = edges[key]
                at[node] = number
        self.token_at, self.final_at = np.array(self.token_at, np.int32), np.array(self.final_at, np.int32)
        self.trie = HashTable(np.fromiter(edges.keys(), np.int64), np.fromiter(edges.values(), np.int64))
        top = max(vocabulary["right"], default=0) + 1
        self.right, self.right_end = _spines(vocabulary["right"], top)
        self.left, self.left_end = _spines(vocabulary["left"], top)
        pairs = vocabulary["pairs"]
        self.pairs = HashTable(np.fromiter(pairs.keys(), np.int64), np.fromiter(pairs.values(), np.int64))
        self._forget(seams)

    def _forget(self, seams: int) -> None:
        self.limit, self.seams = seams, HashTable(np.zeros(0, np.int64), np.zeros(0, np.int64), seams)

    def arrays(self) -> dict:
        """All of it as plain arrays, which can be broadcast: far smaller than the compiled vocabulary's dicts."""
        own = {k: getattr(self, k) for k in ("token_at", "final_at", "right", "right_end", "left", "left_end")}
        return own | {"trie": self.trie.arrays(), "pairs": self.pairs.arrays()}

    @classmethod
    def of(cls, arrays: dict, seams: int) -> Tables:
        table = cls.__new__(cls)
        for name, value in arrays.items():
            setattr(table, name, HashTable.of(value) if name in ("trie", "pairs") else value)
        table._forget(seams)
        return table

    def _check(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        fits = np.ones(len(before), bool)
        for i in range(self.right.shape[1]):
            for j in range(self.left.shape[1]):
                x, y = self.right[before, i], self.left[token, j]
                at = np.flatnonzero(fits & (x >= 0) & (y >= 0))
                if not len(at):
                    break
                rank = self.pairs.get(x[at].astype(np.int64) << 20 | y[at], NEVER)
                fits[at[(rank < self.right_end[before[at], i]) & (rank <= self.left_end[token[at], j]) & (rank < NEVER)]] = False
        return fits

    def fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """True where no merge reaches over the seam between the two tokens; remembers what it finds."""
        keys = before.astype(np.int64) << 20 | token
        known = self.seams.get(keys)
        if (known < 0).any():
            new = np.unique(keys[known < 0])
            if self.seams.size + len(new) > self.limit:
                self.seams = HashTable(np.zeros(0, np.int64), np.zeros(0, np.int64), max(self.limit, 2 * len(new)))
            self.seams.insert(new, self._check(new >> 20, new & 0xFFFFF).astype(np.int64))
            rest = known < 0
            known[rest] = self.seams.get(keys[rest])
            if (known < 0).any():  # known before the table was renewed
                rest = known < 0
                known[rest] = self._check(before[rest], token[rest])
        return known > 0


#: Seams that a worker remembers.
SEAMS = 1 << 18


def tables(vocabulary: dict) -> Tables:
    """The arrays of a compiled vocabulary, or of one that came as arrays (see bpe.packed)."""
    build = (lambda: Tables.of(vocabulary["arrays"], SEAMS)) if "arrays" in vocabulary else (lambda: Tables(vocabulary, SEAMS))
    return once(f"tables {vocabulary['name']}", build)


def _endings(t: Tables, data: np.ndarray, bounds: np.ndarray, final: bool) -> tuple[np.ndarray, ...]:
    """Piece, end in the piece, size and id of every token that occurs anywhere."""
    piece = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    stop = bounds[1:][piece].astype(np.int32)
    at, node = np.arange(len(data), dtype=np.int32), np.zeros(len(data), np.int64)
    found = []
    size = 0
    while len(at):
        node = t.trie.get(node << 8 | data[at + size].astype(np.int64))
        alive = node >= 0
        at, node = at[alive], node[alive]
        size += 1
        end = at + size
        token = np.where(end == stop[at], t.final_at[node], t.token_at[node]) if final else t.token_at[node]
        hit = np.flatnonzero(token >= 0)
        p = piece[at[hit]]
        found.append((p, (end[hit] - bounds[p]).astype(np.int32), np.full(len(hit), size, np.int32), token[hit]))
        more = end < stop[at]
        at, node = at[more], node[more]
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int32) for k in range(4))


class Prefixes:
    """last, sizes and counts of all prefixes: entry base[p] + e belongs to the first e bytes of piece p."""

    def __init__(self, vocabulary: dict, data: np.ndarray, bounds: np.ndarray):
        t = tables(vocabulary)
        pieces = len(bounds) - 1
        self.lengths = np.diff(bounds)
        self.base = bounds[:-1] + np.arange(pieces)
        self.last = np.full(len(data) + pieces, -1, np.int64)
        self.sizes = np.zeros(len(data) + pieces, np.int32)
        self.counts = np.zeros(len(data) + pieces, np.int32)
        piece, end, size, token = _endings(t, data, bounds, vocabulary["final"] is not None)
        order = np.argsort(end, kind="stable")
        piece, end, size, token = piece[order], end[order], size[order], token[order]
        edges = np.searchsorted(end, np.arange(1, (int(self.lengths.max()) if pieces else 0) + 2))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            to = self.base[piece[a:b]] + end[a:b]
            before = self.last[to - size[a:b]]
            whole = size[a:b] == end[a:b]
            ask = np.flatnonzero(~whole & (before >= 0))
            good = whole.copy()
            good[ask] = t.fits(before[ask], token[a:b][ask])
            to, s = to[good], size[a:b][good]
            self.last[to], self.sizes[to], self.counts[to] = token[a:b][good], s, self.counts[to - s] + 1

    def token_counts(self) -> np.ndarray:
        return self.counts[self.base + self.lengths]

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and where each piece's ids start (and the last ones end)."""
        bounds = np.concatenate([[0], np.cumsum(self.token_counts())])
        out = np.zeros(bounds[-1], np.int64)
        at, first = self.base + self.lengths, bounds[:-1]
        live = np.flatnonzero(self.lengths > 0)
        while len(live):
            here = at[live]
            if (self.last[here] < 0).any():
                raise ValueError("a piece that the vocabulary cannot spell")
            out[first[live] + self.counts[here] - 1] = self.last[here]
            at[live] -= self.sizes[here]
            live = live[at[live] > self.base[live]]
        return out, bounds
