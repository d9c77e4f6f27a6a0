"""Simple-8b word-aligned coding of unsigned integers, vectorised.

A 64-bit word holds a 4-bit selector and 60 bits of payload; the selector tells how many values of
how many bits the payload holds. Values go into blocks of BLOCK; the word offset of every block is
kept, so that blocks decode on their own and all together. A value of 60 bits or more is escaped:
a word with selector 0, then the value as a raw word; positions of raw words are listed.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
ESCAPE = 0
#: values to a word, by selector; selector 0 is the escape, 15 is free
COUNTS = [1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
#: bits of each value, by selector
BITS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
_COUNT = np.array([*COUNTS, 0], np.int64)


#: zeros kept behind each block, so that no word looks into the next one
_PAD = 64
#: blocks that are encoded at once; this bounds memory, not results
_AT_ONCE = 128


def _smallest(values: np.ndarray) -> np.ndarray:
    out = np.full(len(values), 64, np.uint8)
    for bits in sorted(set(BITS[1:]), reverse=True):
        out[values < np.uint64(1 << bits)] = bits
    return out


#: the smallest payload width that holds a value below 2 ** 16
_SMALL = _smallest(np.arange(1 << 16, dtype=np.uint64))


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    """The smallest payload width that holds each value, 64 where none does."""
    out = _SMALL[np.minimum(values, np.uint64(0xFFFF)).astype(np.uint16)]
    large = np.flatnonzero(values > np.uint64(0xFFFF))
    if len(large):
        out[large] = _smallest(values[large])
    return out


def _selectors(width: np.ndarray) -> np.ndarray:
    """For every position, the selector of the fullest word that could start there."""
    n = len(width)
    out = np.zeros(n, np.uint8)
    longest = np.concatenate([width, np.zeros(_PAD, np.uint8)])  # widest of the next `span` values
    span, widest = 1, {1: longest}
    while span < 32:
        longest = np.maximum(longest, np.concatenate([longest[span:], np.zeros(span, np.uint8)]))
        span *= 2
        widest[span] = longest
    for selector in range(len(COUNTS) - 1, 0, -1):
        count, bits = COUNTS[selector], BITS[selector]
        power = 1 << (count.bit_length() - 1)
        of = widest[power]
        top = of[:n] if power == count else np.maximum(of[:n], of[count - power : count - power + n])
        fits = top <= bits
        if fits.any():
            out[fits] = selector
    return out


def _encode_blocks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words of each block, indexes of raw words."""
    blocks, stride = -(-len(values) // BLOCK), BLOCK + _PAD
    padded = np.zeros((blocks, stride), np.uint64)
    width = np.zeros((blocks, stride), np.uint8)
    for into, what in ((padded, values), (width, _bit_lengths(values))):
        full = len(values) // BLOCK
        into[:full, :BLOCK] = what[: full * BLOCK].reshape(full, BLOCK)
        if full < blocks:
            into[full, : len(values) - full * BLOCK] = what[full * BLOCK :]
    padded = padded.ravel()
    # past the end of a block widths are 0, so that its last word is filled up with zeros
    selector = _selectors(width.ravel())
    step = _COUNT[selector]
    begin, many = [], []
    for k in range(blocks):
        ahead = step[k * stride : k * stride + BLOCK].tolist()
        pos, end, starts = 0, min(BLOCK, len(values) - k * BLOCK), []
        while pos < end:
            starts.append(pos)
            pos += ahead[pos] or 1
        begin.append(np.array(starts, np.int64) + k * stride)
        many.append(len(starts))
    begin, many = np.concatenate(begin), np.array(many, np.int64)
    chosen = selector[begin]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        if s == ESCAPE:
            continue
        here = np.flatnonzero(chosen == s)
        word = words[here]
        for lane in range(COUNTS[s]):
            word |= padded[begin[here] + lane] << np.uint64(lane * BITS[s])
        words[here] = word
    raw = np.flatnonzero(chosen == ESCAPE)
    if len(raw):
        words = np.insert(words, raw + 1, padded[begin[raw]])
        many += np.bincount(np.repeat(np.arange(blocks), many)[raw], minlength=blocks)
        raw = raw + 1 + np.arange(len(raw))
    return words, many, raw


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, word offset of every block (and the end), indexes of raw words."""
    words, many, raw, total = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)], [np.empty(0, np.int64)], 0
    for at in range(0, len(values), BLOCK * _AT_ONCE):
        w, m, r = _encode_blocks(np.ascontiguousarray(values[at : at + BLOCK * _AT_ONCE], np.uint64))
        words.append(w)
        many.append(m)
        raw.append(r + total)
        total += len(w)
    return np.concatenate(words), np.cumsum(np.concatenate(many)).astype(np.uint64), np.concatenate(raw).astype(np.uint64)


def decode(words: np.ndarray, offsets: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """The n values of all blocks at once."""
    if not n:
        return np.empty(0, np.uint64)
    is_raw = np.zeros(len(words), bool)
    is_raw[raw.astype(np.int64)] = True
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = np.where(is_raw, 0, _COUNT[selector])
    # start of every word within its block, which begins at a multiple of BLOCK
    before = np.concatenate([[0], np.cumsum(count)])
    first = offsets[:-1].astype(np.int64)
    block = np.repeat(np.arange(len(first)), np.diff(offsets.astype(np.int64)))
    start = before[:-1] - before[first][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s in range(1, len(COUNTS)):
        here = np.flatnonzero((selector == s) & ~is_raw)
        if not len(here):
            continue
        mask = np.uint64((1 << BITS[s]) - 1)
        # only a block's last word can hold fewer values than its lanes
        short = start[here] + COUNTS[s] > end[here]
        inner, last = here[~short], here[short]
        for lane in range(COUNTS[s]):
            shift = np.uint64(lane * BITS[s])
            out[start[inner] + lane] = (words[inner] >> shift) & mask
            held = last[start[last] + lane < end[last]]
            out[start[held] + lane] = (words[held] >> shift) & mask
    escaped = np.flatnonzero((selector == ESCAPE) & ~is_raw)
    out[start[escaped]] = words[escaped + 1]
    return out
