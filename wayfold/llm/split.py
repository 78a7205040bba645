"""Pieces of text before byte-pair merging, for a whole block of texts at once.

The pattern is public_tokenizers.PATTERN: contractions, runs of letters, digits or other characters with at most one
space before them, and white space. Its matches cover the text, so their starts say everything.
"""

from __future__ import annotations

import sys

import numpy as np

from wayfold.llm.arrays import once

OTHER, LETTER, NUMBER, SPACE = range(4)
#: White_Space of Unicode.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"


def _character_kinds() -> np.ndarray:
    import unicodedata

    major = {"L": LETTER, "N": NUMBER}
    kinds = np.array([major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    kinds[[ord(c) for c in SPACES]] = SPACE
    return kinds


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to."""
    table = once("character kinds", _character_kinds)
    kinds = table[data]  # right for ASCII
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0xFF >> (size + 1))
        for k in (1, 2, 3):
            more = size > k
            point[more] = point[more] << 6 | (data[lead[more] + k] & 0x3F)
        found = table[point]
        for k in (0, 1, 2, 3):
            more = size > k
            kinds[lead[more] + k] = found[more]
    return kinds


def match_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the matches start; each ends where the next one starts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kinds = byte_kinds(data)
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    starts = text_start[:n].copy()
    starts[1:] |= kinds[1:] != kinds[:-1]
    run_starts = starts.copy()
    # The last white-space character before another run is a match of its own, or the space in front of that run.
    after = np.flatnonzero(starts[1:] & (kinds[:-1] == SPACE) & ~text_start[1:n]) + 1
    last = after - 1
    for _ in range(3):
        last = last - (data[last] & 0xC0 == 0x80)
    starts[last] = True
    starts[after[data[last] == 0x20]] = False
    # A contraction: an apostrophe where a match starts, alone before letters.
    quote = np.flatnonzero((data[: n - 1] == 0x27) & starts[: n - 1] & run_starts[: n - 1] & (kinds[1:] == LETTER) & ~text_start[1:n])
    one = data[quote + 1]
    two = np.where((quote + 2 < n) & ~text_start[np.minimum(quote + 2, n)], data[np.minimum(quote + 2, n - 1)], 0)
    short = np.isin(one, list(b"stmd"))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for which, size in ((short, 2), (long, 3)):
        at = quote[which]
        starts[at + 1] = False
        ends = at + size
        starts[ends[ends < n]] = True
    return np.flatnonzero(starts)
