"""Token counts without tokens: one transducer over bytes, run in chunks whose maps are composed by a prefix scan.

The transducer is deterministic and has two levels. The upper one finds words: few states, with outputs where a word
starts. The lower one reads a word: its states are the beginnings of words, and the transition on a byte (marked if the
word ends with it) emits the change in the number of tokens, which may be negative. It is compiled as words come up.

Texts are cut into chunks. For every state that may hold before a chunk, its map tells the state after it, the tokens
emitted by the words that begin and end in it, where its first cut between words lies, and where the word begins that is
still open at its end. Two maps compose into one of the same kind: counts add up, and the word over the seam, from the open
word's beginning to the first cut, emits its tokens. A prefix scan over the chunks of a text gives the text's count.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import LOWER, once, text_blocks
from wayfold.llm.bpe import LONG, SLICE, PrefixTable, compile_vocabulary, distinct_pieces, ranges
from wayfold.llm.prefixes import HashTable, Prefixes
from wayfold.llm.split import LETTER, NUMBER, OTHER, SPACE, byte_kinds
from wayfold.llm.store import free_names

CHUNK = 512
BLOCK = 2 << 20
END_OF_WORD = "</w>"
#: Transitions that a Python worker remembers; beyond, it starts anew, and none of the counts change.
STATES = 1 << 19
NONE = -2

# Inputs of the scan: bytes by their part in the pattern. INSIDE is every further byte of a character, and padding.
INSIDE, BLANK, WORD, DIGIT, SIGN, QUOTE, STDM, R_OR_V, L, E = range(10)
# States: no open match; in letters; in other characters; after an apostrophe that may begin a contraction; after such an
# apostrophe and a letter that needs an e, or an l, to complete it.
FREE, LETTERS, SIGNS, QUOTED, NEEDS_E, NEEDS_L = range(6)
# Outputs: a match starts at this byte; one started at the byte before.
HERE, BEFORE = 1, 2


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output of each state and input, for contractions, letter runs, single digits and runs of the rest."""
    letters = (WORD, STDM, R_OR_V, L, E)
    after, output = np.zeros((6, 10), np.uint8), np.zeros((6, 10), np.uint8)
    opened = {BLANK: FREE, DIGIT: FREE, SIGN: SIGNS, QUOTE: QUOTED} | {x: LETTERS for x in letters}
    for state in range(6):
        for symbol, then in opened.items():
            after[state, symbol], output[state, symbol] = then, HERE if symbol != BLANK else 0
        after[state, INSIDE] = state
    output[LETTERS, letters] = 0
    for symbol in (SIGN, QUOTE):
        for state in (SIGNS, QUOTED):
            after[state, symbol], output[state, symbol] = SIGNS, 0
    for symbol, then in ((STDM, FREE), (R_OR_V, NEEDS_E), (L, NEEDS_L)):
        after[QUOTED, symbol], output[QUOTED, symbol] = then, 0
    for state, completing in ((NEEDS_E, E), (NEEDS_L, L)):
        output[state, :] |= BEFORE
        output[state, letters] &= BEFORE
        output[state, INSIDE] = 0
        after[state, completing], output[state, completing] = FREE, 0
    return after, output


def inputs(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    by_kind = np.zeros(4, np.uint8)
    by_kind[[SPACE, LETTER, NUMBER, OTHER]] = BLANK, WORD, DIGIT, SIGN
    special = np.zeros(256, np.uint8)
    for symbol, characters in ((QUOTE, b"'"), (STDM, b"stdm"), (R_OR_V, b"rv"), (L, b"l"), (E, b"e")):
        special[list(characters)] = symbol
    out = np.where(special[data] > 0, special[data], by_kind[kinds])
    out[data & 0xC0 == 0x80] = INSIDE
    return out


class Transducer:
    """The lower level: numbers of tokens of words, by transitions that are compiled when a word first needs them."""

    def __init__(self, vocabulary: dict):
        self.vocabulary = vocabulary
        self._forget(0)

    def _forget(self, states: int) -> None:
        self.limit, self.states = max(STATES, states) + 1, 1
        self.after = HashTable(np.zeros(0, np.int64), np.zeros(0, np.int64), self.limit)
        self.emitted = np.zeros(self.limit + 1, np.int32)

    def _run(self, data: np.ndarray, bounds: np.ndarray, emits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Emitted tokens of each word, and whether all its transitions are there; with emits, what each byte emits, they are added."""
        sizes = np.diff(bounds)
        state, total, known = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.ones(len(sizes), bool)
        live, at = np.flatnonzero(sizes > 0), 0
        while len(live):
            place = bounds[live] + at
            keys = state[live] << 9 | (sizes[live] == at + 1).astype(np.int64) << 8 | data[place]
            to = self.after.get(keys)
            missing = to < 0
            if missing.any() and emits is not None:
                new, first, which = np.unique(keys[missing], return_index=True, return_inverse=True)
                added = np.arange(self.states, self.states + len(new))
                self.after.insert(new, added)
                self.emitted[added] = emits[place[missing][first]]
                self.states += len(new)
                to[missing] = added[which]
            elif missing.any():
                known[live[missing]] = False
                live, to = live[~missing], to[~missing]
            total[live] += self.emitted[to]
            state[live] = to
            at += 1
            live = live[sizes[live] > at]
        return total, known

    def _compiled(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Emitted tokens of words that lack transitions, which are made from the counts of all beginnings of these words."""
        if self.states + len(data) > self.limit:
            self._forget(len(data))
        made = Prefixes(self.vocabulary, data, bounds)
        inside = np.ones(len(made.counts), bool)
        inside[made.base + made.lengths] = False
        return self._run(data, bounds, np.diff(made.counts, append=0)[inside])[0]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The tokens of each of these words. Equal words are read once; one of over LONG bytes leaves no transitions behind."""
        if not len(starts):
            return np.zeros(0, np.int64)
        where, which = distinct_pieces(data, starts, ends)
        starts, sizes = starts[where], (ends - starts)[where]
        short = np.where(sizes > LONG, 0, sizes)
        found, known = self._run(ranges(data, starts, short), np.concatenate([[0], np.cumsum(short)]).astype(np.int64))
        new = np.flatnonzero(~known)
        upto = np.cumsum(sizes[new])
        cuts = np.searchsorted(upto, np.arange(SLICE, upto[-1], SLICE)) if len(new) else []
        for part in np.split(new, cuts):
            if len(part):
                bounds = np.concatenate([[0], np.cumsum(sizes[part])]).astype(np.int64)
                found[part] = self._compiled(ranges(data, starts[part], sizes[part]), bounds)
        for k in np.flatnonzero(sizes > LONG).tolist():
            piece = data[starts[k] : starts[k] + sizes[k]].tobytes()
            found[k] = PrefixTable(self.vocabulary, piece, whole_word=True).counts[-1]
        return found[which]


class Maps(NamedTuple):
    """Maps of stretches of text, a row for each and a column for each state before it; places are byte positions of the block."""

    exits: np.ndarray  # the state after the stretch
    counts: np.ndarray  # tokens of the words between cuts of the stretch
    head: np.ndarray  # the first cut, or NONE
    tail: np.ndarray  # where the word begins that is open at the end; NONE if none is or there is no cut

    def rows(self, which: np.ndarray) -> Maps:
        return Maps(*(x[which] for x in self))


def compose(first: Maps, then: Maps, words) -> Maps:
    """The maps of first followed by those of then; words(starts, ends) gives the tokens of words over the seam."""
    at = first.exits.astype(np.int64)
    then = Maps(*(np.take_along_axis(x, at, axis=1) for x in then))
    counts = first.counts + then.counts
    over = np.nonzero((first.tail != NONE) & (then.head > first.tail))
    both, which = np.unique(np.stack([first.tail[over], then.head[over]]), axis=1, return_inverse=True)
    counts[over] += words(both[0], both[1])[which.ravel()]
    cut = then.head != NONE
    return Maps(then.exits, counts, np.where(first.head != NONE, first.head, then.head), np.where(cut, then.tail, first.tail))


def scan_maps(maps: Maps, number: np.ndarray, words) -> Maps:
    """Each chunk's map composed with those of all chunks before it in its text; number counts the chunks within a text."""
    total, step = Maps(*(x.copy() for x in maps)), 1
    while step <= int(number.max(initial=0)):
        late = np.flatnonzero(number >= step)
        for whole, part in zip(total, compose(total.rows(late - step), total.rows(late), words)):
            whole[late] = part
        step *= 2
    return total


def chunk_maps(symbols: np.ndarray, blank: np.ndarray, starts: np.ndarray, ends: np.ndarray, words) -> Maps:
    """The maps of chunks. Behind its first blank or digit a chunk goes on alike whatever came before, so only what lies
    before that is read once for each state."""
    after, output = once("count transitions", _transitions)
    lanes, n, sizes = len(starts), len(symbols), ends - starts
    same = np.append(np.flatnonzero((symbols == BLANK) | (symbols == DIGIT)), n)
    meet = np.minimum(same[np.searchsorted(same, starts)], ends)
    met = meet < ends

    # Behind the meeting point: one state per chunk.
    lane, at = np.repeat(np.arange(lanes), sizes), np.arange(n) - np.repeat(starts, sizes)
    body = np.arange(n) >= meet[lane]
    grid = np.full((int(sizes.max(initial=0)), lanes), INSIDE, np.uint8)
    grid[at[body], lane[body]] = symbols[body]
    emitted, state = np.zeros_like(grid), np.full(lanes, FREE, np.uint8)
    for t, row in enumerate(grid):
        emitted[t] = output[state, row]
        state = after[state, row]
    flat = np.where(body, emitted[at, lane], 0)
    begins = flat & HERE > 0
    begins[np.flatnonzero(flat & BEFORE) - 1] = True
    cuts = begins.copy()
    cuts[1:] |= blank[1:] & ~blank[:-1] & body[1:]
    cuts[meet[met]] = True
    begins, cuts = np.flatnonzero(begins), np.append(np.flatnonzero(cuts), n)
    stops, owner = cuts[np.searchsorted(cuts, begins, "right")], lane[begins]
    closed = stops < ends[owner]
    open_at = np.full(lanes, NONE)
    open_at[owner[~closed]] = begins[~closed]

    # Before it: all states; the chunks that take longest come first.
    exits = np.repeat(np.arange(6, dtype=np.uint8)[None], lanes, axis=0)
    steps = meet - starts + met
    order = np.argsort(-steps, kind="stable")
    going = np.searchsorted(-steps[order], -np.arange(int(steps.max(initial=0))), "left")
    rows = []
    for t, k in enumerate(going.tolist()):
        who = order[:k]
        place = starts[who] + t
        put = output[exits[who], symbols[place][:, None]]
        exits[who] = after[exits[who], symbols[place][:, None]]
        for flag, back in ((HERE, 0), (BEFORE, 1)):
            r, q = np.nonzero(put & flag)
            # What starts at the meeting point itself is read above.
            ours = (place[r] < meet[who[r]]) if flag == HERE else slice(None)
            r, q = r[ours], q[ours]
            rows.append((who[r] * 6 + q, place[r] - back, np.ones(len(r), bool)))
    inside_blank = np.flatnonzero(blank[starts] & (symbols[starts] == INSIDE))
    for which, where in ((np.flatnonzero(met), meet[met]), (inside_blank, starts[inside_blank])):
        rows.append(((which[:, None] * 6 + np.arange(6)).ravel(), np.repeat(where, 6), np.zeros(6 * len(which), bool)))
    path, place, begun = (np.concatenate([r[k] for r in rows]) for k in range(3))
    order = np.lexsort((place, path))
    path, place, begun = path[order], place[order], begun[order]
    last = np.append(path[1:] != path[:-1], True)[: len(path)]
    head, tail = np.full(lanes * 6, NONE), np.full(lanes * 6, NONE)
    first = np.flatnonzero(np.insert(last[:-1], 0, True)[: len(path)])
    head[path[first]] = place[first]
    tail[path[last & begun]] = place[last & begun]
    early = np.flatnonzero(begun & ~last)

    tokens = words(np.concatenate([begins[closed], place[early]]), np.concatenate([stops[closed], place[early + 1]]))
    own, before = tokens[: closed.sum()], tokens[closed.sum() :]
    counts = np.bincount(path[early], weights=before, minlength=lanes * 6).astype(np.int64).reshape(lanes, 6)
    counts += np.bincount(owner[closed], weights=own, minlength=lanes).astype(np.int64)[:, None]
    head, tail = head.reshape(lanes, 6), tail.reshape(lanes, 6)
    exits[met], tail[met] = state[met, None], open_at[met, None]
    return Maps(exits, counts, head, tail)


def emitted_tokens(vocabulary: dict, data: np.ndarray, symbols: np.ndarray, blank: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each text."""
    lower = once(f"transducer {vocabulary['name']}", lambda: Transducer(vocabulary))
    words = lambda starts, ends: lower.words(data, starts, ends)
    lengths = np.diff(offsets)
    chunks = -(-lengths // CHUNK)
    lanes = int(chunks.sum())
    out = np.zeros(len(lengths), np.int64)
    if not lanes:
        return out
    number = np.arange(lanes) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    starts = np.repeat(offsets[:-1], chunks) + number * CHUNK
    ends = np.minimum(starts + CHUNK, np.repeat(offsets[1:], chunks))
    total = scan_maps(chunk_maps(symbols, blank, starts, ends, words), number, words)
    # Each text's last chunk, from the state that texts begin in, and the word that the text's end closes.
    last = np.append(np.flatnonzero(number[1:] == 0), lanes - 1)
    texts = np.flatnonzero(chunks)
    out[texts] = total.counts[last, FREE]
    tail, stop = total.tail[last, FREE], ends[last]
    two = np.isin(total.exits[last, FREE], (NEEDS_E, NEEDS_L)) & (tail != NONE)
    for which, a, b in ((tail != NONE, tail, stop - two), (two, stop - 1, stop)):
        out[texts[which]] += words(a[which], b[which])
    return out


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files: printable ones themselves, the rest from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def compile_file(spec: str) -> dict:
    """The vocabulary of a tokenizers file with word ends, and its special strings."""
    model = json.loads(spec)
    vocabulary, alphabet = model["model"]["vocab"], byte_alphabet()
    special = [t["content"] for t in model["added_tokens"]]
    tokens, final, symbols = {}, {}, {}
    for token, number in vocabulary.items():
        ends = token.endswith(END_OF_WORD)
        characters = token.removesuffix(END_OF_WORD) if ends else token
        if token in special or not characters or any(c not in alphabet for c in characters):
            continue
        (final if ends else tokens)[bytes(alphabet[c] for c in characters)] = number
        parts = [*characters[:-1], characters[-1] + (END_OF_WORD if ends else "")]
        symbols[number] = [vocabulary[p] for p in parts]
    pairs = {}
    for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]):
        pairs.setdefault(vocabulary[a] << 20 | vocabulary[b], (rank, vocabulary[a + b]))
    return compile_vocabulary(tokens, symbols, pairs, final) | {"special": special}


def normalise(text: str) -> str:
    """NFC, then each character in lower case; white space needs no unifying, since it only separates."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def prepared(data: np.ndarray, offsets: np.ndarray, special: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, their offsets, the text that each stretch of them belongs to, and special strings per text.

    A special string is one token and parts its text in two.
    """
    texts = len(offsets) - 1
    raw = data.tobytes()
    odd = any(s.encode() in raw for s in special)
    if not odd and not (data >= 0x80).any():
        return LOWER[data], offsets, np.arange(texts), np.zeros(texts, np.int64)
    pattern = re.compile("|".join(re.escape(s) for s in special)) if odd else None
    parts, owner, extra = [], [], np.zeros(texts, np.int64)
    for t, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        text = raw[a:b].decode()
        pieces = pattern.split(text) if odd else [text]
        extra[t] = len(pieces) - 1
        parts += [p.lower().encode() if p.isascii() else normalise(p).encode() for p in pieces]
        owner += [t] * len(pieces)
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), np.array(owner), extra


def count_block(vocabulary: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each text of a block."""
    data, offsets, owner, counts = prepared(data, offsets, vocabulary["special"])
    if not len(data):
        return counts
    kinds = byte_kinds(data)
    found = emitted_tokens(vocabulary, data, inputs(data, kinds), kinds == SPACE, offsets)
    return counts + np.bincount(owner, weights=found, minlength=len(counts)).astype(np.int64)


def count_tokens(docs: DataFrame, tokenizer: str, *, keep: list[str], text: str = "text", limit: int = 2048) -> DataFrame:
    """The columns keep with n_bytes, n_tokens and over_limit, for the content of a tokenizers file.

    A null or empty text has no bytes and no tokens; rows are counted one by one, whatever they repeat. A new
    column whose name keep has already gets underscores at its end, and keep's column stays as it is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compile_file(tokenizer))
    rows = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)] + [F.col(text).alias("text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts = [], []
            for _, _, data, offsets in text_blocks(batch.column(batch.num_columns - 1), BLOCK):
                sizes.append(np.diff(offsets))
                counts.append(count_block(shared.value, data, offsets))
            columns = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (sizes, counts)]
            names = [*batch.schema.names[:-1], "n_bytes", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    counted = rows.mapInArrow(run, ", ".join([*kinds, "n_bytes long", "n_tokens long"]))
    names = free_names(["n_bytes", "n_tokens", "over_limit"], keep)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit).toDF(*keep, *names)
