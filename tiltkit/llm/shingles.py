"""Word shingles of whole texts as 64-bit hashes, vectorised over many texts.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r, A-Z lower-cased.
Equal words (shingles) have equal hashes; unlike ones agree by chance only
(64 bits)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text that are hashed at a time.
CHUNK = 1 << 18
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of each number over all 64."""
    h = (h ^ (h >> _U(32))) * _U(0x9E6C63D0876A9A99)
    h = (h ^ (h >> _U(29))) * _U(0xC4A1B9F54C2D7E63)
    return h ^ (h >> _U(32))


_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: Words longer than this are hashed one by one.
LONG_WORD = 64


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a byte array. A word is read in lanes of
    8 bytes; every lane is mixed into the hash before the next one is read, so
    a hash depends on the lanes' order as well as on each bit of them."""
    gap = np.concatenate([[True], _GAP[data], [True]])
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = turn[::2], turn[1::2]
    sizes = ends - starts
    # the 8 bytes from every position on (the last ones are padded)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    lanes = np.ndarray(shape=len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    hashes = _mix(sizes.astype(np.uint64) + _U(0x2545F4914F6CDD1D))
    now = np.flatnonzero(sizes <= LONG_WORD)
    at = 0
    while len(now):
        left = np.minimum(sizes[now] - at, 8).astype(np.uint64)
        lane = lanes[starts[now] + at] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * left))
        hashes[now] = _mix((hashes[now] ^ lane) * _U(0xD1342543DE82EF95) + _U(at))
        at += 8
        now = now[sizes[now] > at]
    for i in np.flatnonzero(sizes > LONG_WORD):
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes())
    return starts, hashes


def _fold(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row."""
    n = len(w) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h = _mix(h * _U(0xD1342543DE82EF95) + w[j:n + j])
    return h


def _chunk_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    data = b"\n".join(texts).lower()
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    starts, hashes = _word_hashes(np.frombuffer(data, dtype=np.uint8))
    of = np.searchsorted(begins, starts, side="right") - 1
    counts = np.bincount(of, minlength=len(texts))
    firsts = np.concatenate([[0], np.cumsum(counts)])
    sets: list[np.ndarray] = [np.empty(0, dtype=np.uint64)] * len(texts)
    if len(hashes) >= k:
        shingle, owner = _fold(hashes, k), of[:len(of) - k + 1]
        whole = owner == of[k - 1:]
        shingle, owner = shingle[whole], owner[whole]
        order = np.lexsort((shingle, owner))
        shingle, owner = shingle[order], owner[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
        shingle, owner = shingle[new], owner[new]
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        sets = [shingle[a:b] for a, b in zip(cut, cut[1:])]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        sets[i] = _fold(hashes[firsts[i]:firsts[i + 1]], int(counts[i]))
    return sets


def shingle_sets(texts: Iterator[bytes], k: int) -> Iterator[np.ndarray]:
    """Per text, in order: its distinct k-word shingles as sorted hashes. With
    fewer words the whole sequence is the one shingle; without words none."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= CHUNK:
            yield from _chunk_sets(held, k)
            held, size = [], 0
    if held:
        yield from _chunk_sets(held, k)
