"""Words as 64-bit fingerprints, for operators that compare texts by word sequence.

Words are ``[^\\x20\\x09-\\x0D]+`` throughout. The fingerprints come straight from Arrow's buffers: no
Python object is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessella.llm.common import mix64

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Keeps the low k bytes of eight.
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of an Arrow string column, nulls as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def word_fingerprints(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of a string column, laid end to end, and where each row's words end. Nulls have none."""
    rows = column.cast(pa.large_string()).fill_null("")
    _, places, data = rows.buffers()
    offsets = np.frombuffer(places, np.int64, len(rows) + 1, rows.offset * 8)
    text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    size = len(text)
    if not size:
        return np.empty(0, U), np.zeros(len(rows), np.int64)
    text = np.append(LOWER[text] if lower else text, np.zeros(8, np.uint8))
    part = np.ones(size + 1, bool)
    part[:size] = ~SPACE[text[:size]]
    part[size] = False
    begins = part[:size].copy()
    begins[1:] &= ~part[: size - 1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < size)]
    begins[cuts] = part[cuts]
    starts = np.flatnonzero(begins)
    # A word ends at white space, at the next word, or at its row's end.
    stops = np.flatnonzero(part[:size] & (~part[1:] | np.append(begins[1:], False))) + 1
    left = stops - starts
    out = mix64(left.astype(U) + U(0x2545F4914F6CDD1D))
    eight = np.ndarray((size + 1,), "<u8", text.tobytes(), 0, (1,))
    at, live = starts, np.arange(len(starts))
    with np.errstate(over="ignore"):
        while len(live):
            out[live] = mix64(out[live] * U(0x9E3779B97F4A7C15) ^ (eight[at] & MASKS[np.minimum(left, 8)]))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
    return out, np.searchsorted(starts, offsets[1:])


def window_names(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """One fingerprint for each ``width`` consecutive words: a polynomial of word fingerprints by doubling, then mixed.

    Doubling: the name of 2k words follows from two names of k words, so a window costs a few operations whatever its width.
    """
    if len(words) < width:
        return np.empty(0, U)
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        power = U((0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64 | 1)
        part, size, out, done, left = words * U(0x9FB21C651E98DF25), 1, None, 0, width
        while True:
            if left & 1:
                piece = part[done : done + n]
                out = piece.copy() if out is None else out * power + piece
                done += size
            left >>= 1
            if not left:
                return mix64(out ^ U(seed))
            part, power, size = part[:-size] * power + part[size:], power * power, size * 2
