"""Simple-8b: a 4-bit selector and 60 bits of payload in each 64-bit word.

Selector 0 is the escape: the next word holds one value of up to 64 bits as it is.  Selectors 2 to 15
hold 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 values.  Values come in blocks of 128; where each
block's words start is stored, so blocks decode independently and all at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
# Bits of a value under selectors 2, 3, ... 15.
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNT = tuple(60 // b for b in BITS)
ESCAPE = 0
U = np.uint64


STRIDE = BLOCK + 60  # a block and what its last word may reach beyond it
LIMITS = np.array([1 << b for b in BITS], U)
#: For ids under 2^16, the first of BITS that holds them.
SMALL = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=U), side="right").astype(np.uint8)
STEP = np.array([1, 1, *COUNT])


def _all_within(fits: np.ndarray, count: int) -> np.ndarray:
    """Where this and the next count-1 entries are all true."""
    have = 1
    while have * 2 <= count:
        fits[:-have] &= fits[have:].copy()
        have *= 2
    if have < count:
        fits[: have - count] &= fits[count - have :].copy()
    return fits


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): offsets[i] is where block i's words start, one more entry ends the last."""
    n = len(values)
    if not n:
        return np.empty(0, U), np.zeros(1, np.uint32)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, U)
    padded[:n] = values
    grid = np.zeros((blocks, STRIDE), U)
    grid[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    flat = grid.reshape(-1)
    small = int(flat.max()) < 1 << 16
    kind = SMALL[flat] if small else np.searchsorted(LIMITS, flat, side="right").astype(np.uint8)
    widest = int(kind.max())
    escaped = kind == len(BITS)  # fit no selector
    widest = min(widest, len(BITS) - 1)
    choice = np.full(len(flat), widest + 2, np.uint8)
    for i in range(widest - 1, -1, -1):
        fits = _all_within(kind <= i, COUNT[i])
        if not fits.any():
            break
        choice -= fits  # what fits a selector fits the next wider one, which holds fewer
    choice[escaped] = ESCAPE
    # Blocks step on together, from word to word.
    at = np.arange(blocks) * STRIDE
    end = at + BLOCK
    end[-1] = at[-1] + (n - 1) % BLOCK + 1
    begins = np.zeros(len(flat), bool)
    while len(at):
        begins[at] = True
        at = at + STEP[choice[at]]
        stay = at < end
        at, end = at[stay], end[stay]
    spot = np.flatnonzero(begins)
    pick = choice[spot]
    width = np.where(pick == ESCAPE, 2, 1)
    start = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), U)
    for i, (b, c) in enumerate(zip(BITS, COUNT, strict=True)):
        hit = np.flatnonzero(pick == i + 2)
        if not len(hit):
            continue
        first = spot[hit]
        word = np.full(len(hit), (i + 2) << 60, U)
        for k in range(c):
            word |= flat[first + k] << U(k * b)
        words[start[hit]] = word
    hit = np.flatnonzero(pick == ESCAPE)
    words[start[hit] + 1] = flat[spot[hit]]
    per_block = np.bincount(spot // STRIDE, weights=width, minlength=blocks).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of all blocks."""
    out = np.zeros(n, U)
    if not n:
        return out
    selector = (words >> U(60)).astype(np.int64)
    blocks = len(offsets) - 1
    block = np.repeat(np.arange(blocks), np.diff(offsets.astype(np.int64)))
    held = np.array([1, 0, *COUNT])[selector]
    raw = np.zeros(len(words), bool)
    first_escape = np.nonzero(selector == ESCAPE)[0]
    last = -2
    for i in first_escape:  # a raw word may look like an escape: only in order can it be told
        if i != last + 1:
            raw[i + 1], last = True, i
    # a raw word with another selector's bits is no word of its own
    held[raw] = 0
    done = np.cumsum(held) - held
    base = np.full(blocks, 0, np.int64)
    starts = offsets[:-1].astype(np.int64)
    base[:] = done[starts]
    at = block * BLOCK + done - base[block]
    limit = np.minimum((block + 1) * BLOCK, n)
    escaped = np.nonzero((selector == ESCAPE) & ~raw)[0]
    out[at[escaped]] = words[escaped + 1]
    whole = at + held <= limit
    for i, (b, c) in enumerate(zip(BITS, COUNT, strict=True)):
        mine = selector == i + 2
        if raw.any():
            mine &= ~raw
        mask = U((1 << b) - 1)
        hit = np.flatnonzero(mine & whole)
        first, word = at[hit], words[hit]
        for k in range(c):
            out[first + k] = word >> U(k * b) & mask
        hit = np.flatnonzero(mine & ~whole)
        for k in range(c if len(hit) else 0):
            hit = hit[at[hit] + k < limit[hit]]
            out[at[hit] + k] = words[hit] >> U(k * b) & mask
    return out
