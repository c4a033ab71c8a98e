"""Word shingles of many texts at once, as hashes."""

from __future__ import annotations

import numpy as np

from loomarray.llm.hashing import U, Prefix, mix

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and the text each is in."""
    data = np.frombuffer((b" ".join(texts) + b" ").translate(_LOWER), np.uint8)
    is_word = _WORD[data]
    edge = np.diff(np.concatenate([[0], is_word.view(np.int8)]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, U), np.empty(0, np.int64)
    stops = np.cumsum([len(t) + 1 for t in texts])
    return Prefix(data).span(start, end - start), np.searchsorted(stops, start, side="right")


def shingle_sets(texts: list[bytes], words: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of `words` words of each text: (hashes, number of each text).

    Only A-Z are lowered; words are runs of bytes other than space and tab to carriage return.  The
    hashes of a text ascend.  A text of fewer words has one shingle, of all its words; one without
    words has none.  Hashes have 64 bits and also tell the number of words.
    """
    m = len(texts)
    h, owner = word_hashes(texts)
    if not len(h):
        return np.empty(0, U), np.zeros(m, np.int64)
    count = np.bincount(owner, minlength=m)
    first = np.cumsum(count) - count
    n = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))  # shingles
    text = np.repeat(np.arange(m), n)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(count[text], words)
    out = np.zeros(len(text), U)
    for k in range(words):
        has = length > k
        out[has] = mix((out[has] ^ h[at[has] + k]) * U(0x9E3779B97F4A7C15) + U(k + 1))
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[new], np.bincount(text[new], minlength=m)
