"""64-bit hashes of words and n-grams of whole Arrow columns, the same in every process.

All is numpy over the column's bytes, some MB at a time; nothing is remembered between calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
PART = 1 << 20
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_random = np.random.default_rng(20)
#: A number of each byte, and of each place in a word: its place's power of an odd number.
_BYTES = _random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9FB21C651E98DF25)
_powers = np.cumprod(np.full(256, _ODD))

#: How bytes are read: what each becomes, and whether it separates words.
_ascii = np.arange(256)
_FOLDED = np.where((_ascii >= 65) & (_ascii <= 90), _ascii + 32, _ascii).astype(np.uint8)
BLANKS = (_FOLDED, (_ascii == 32) | ((_ascii >= 9) & (_ascii <= 13)))
#: Only letters and bytes of other scripts are words.
LETTERS = (_FOLDED, (_ascii < 128) & ~(((_ascii >= 97) & (_ascii <= 122)) | ((_ascii >= 65) & (_ascii <= 90))))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _of_bytes(raw: np.ndarray, starts: np.ndarray, read: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``raw``, and of each text that begins at ``starts`` the first one's number."""
    global _powers
    folded, separates = read
    blank = separates[raw]
    begins = ~blank
    begins[1:] &= blank[:-1]
    at = starts[starts < len(raw)]
    begins[at] = ~blank[at]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    place = np.arange(len(raw)) - np.repeat(np.append(0, first), np.diff(np.concatenate(([0], first, [len(raw)]))))
    place[blank] = 0
    if place.max() >= len(_powers):
        _powers = np.cumprod(np.full(int(place.max()) + 1, _ODD))
    terms = _BYTES[folded[raw]] * _powers[place]
    terms[blank] = 0
    return mixed(np.add.reduceat(terms, first)), np.searchsorted(first, starts)


def _long(raw: np.ndarray, read) -> np.ndarray:
    """Word hashes of one long text, read in parts that end between words."""
    out, at = [], 0
    while at < len(raw):
        end = at + PART
        if end < len(raw):
            gaps = np.flatnonzero(read[1][raw[at:end]])
            while not len(gaps) and end < len(raw):
                more = read[1][raw[end : end + PART]]
                gaps = np.flatnonzero(more) + (end - at)
                end += PART
            end = at + int(gaps[-1]) + 1 if len(gaps) else len(raw)
        out.append(_of_bytes(raw[at:end], np.zeros(1, np.int64), read)[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def word_hashes(texts: pa.Array, read=BLANKS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, hashes, ends): of the texts from i on, their words' hashes in one array, and where in it each
    text's words end. A null text has none."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PART, side="right")) - 1)
        raw = data[offsets[i] : offsets[j]]
        if j == i + 1 and len(raw) > PART:
            hashes = _long(raw, read)
            yield i, hashes, np.array([len(hashes)])
        else:
            with np.errstate(over="ignore"):
                hashes, firsts = _of_bytes(raw, (offsets[i:j] - offsets[i]), read)
            yield i, hashes, np.append(firsts[1:], len(hashes))
        i = j


def ngram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-grams of words; A-Z fold, words are runs of
    anything but ASCII white space. With fewer words than n, the whole sequence is one."""
    for _, words, ends in word_hashes(texts):
        grams = _grams(words, n) if len(words) >= n else words[:0]
        start = 0
        for end in ends.tolist():
            if end - start >= n:
                yield np.unique(grams[start : end - n + 1])
            elif end > start:
                yield _grams(words[start:end], end - start)
            else:
                yield words[:0]
            start = end


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            h = mixed(h + words[i : len(words) - n + 1 + i] * FACTORS[i % 8])
    return h


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """``ngram_sets`` of one text."""
    return next(ngram_sets(pa.array([text], pa.string()), n))
