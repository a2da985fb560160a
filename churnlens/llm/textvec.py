"""Vectorised words, shingles and hashes over whole texts, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes worked on at once; longer texts are cut at white space and their words joined again.
SEGMENT = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): a bijection that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, cache: list = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006
    if len(cache[0]) < n:
        cache[0] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 256), _BASE, np.uint64)]), dtype=np.uint64)
    return cache[0]


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of the bytes, A to Z as lower case."""
    word = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inside = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    terms = _BYTE[_LOWER[buf[word]]] * _powers(int(lengths.max()))[inside]
    return starts, ends, mix(np.add.reduceat(terms, at) + lengths.astype(np.uint64))


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about SEGMENT bytes that end at white space (or, in a longer word, only there)."""
    at = 0
    while len(text) - at > SEGMENT:
        end = at + SEGMENT
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its lower-cased words, in order."""
    group: list[bytes] = []
    size = 0
    for text in [*texts, None]:
        if group and (text is None or size + len(text) > SEGMENT):
            buf = np.frombuffer(b"\n".join(group), np.uint8)
            starts, _, hashes = word_spans(buf)
            bounds = np.cumsum([0, *(len(x) + 1 for x in group)])
            cuts = np.searchsorted(starts, bounds)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield hashes[a:b]
            group, size = [], 0
        if text is None:
            return
        if len(text) > SEGMENT:
            yield np.concatenate([word_spans(np.frombuffer(p, np.uint8))[2] for p in pieces(text)])
        else:
            group.append(text)
            size += len(text) + 1


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of k-word shingles; of fewer words the whole sequence is one shingle."""
    n = len(words)
    if not n:
        return words
    rows = words[None, :] if n < k else np.stack([words[i : n - k + 1 + i] for i in range(k)], 1)
    out = np.full(len(rows), np.uint64(rows.shape[1]))
    for j in range(rows.shape[1]):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + rows[:, j])
    return np.unique(out)


def as_bytes(values) -> list[bytes]:
    """Column values as UTF-8; null as empty."""
    return [v.encode("utf-8", "surrogatepass") if isinstance(v, str) else (v or b"") for v in values]
