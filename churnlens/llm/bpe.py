"""Exact token ids and counts of whole texts by public tokenizer files, at far less cost than one encoder call a text.

``WordIds`` is for vocabularies that drop white space and fold case: the text is cut at ASCII white
space, each distinct word is encoded once per worker, and ids are gathered by array arithmetic.
``ByteCounts`` is for byte-level vocabularies. Both hand texts or words with characters outside a
plain set (other white space, control characters, combining marks, special strings) to the library
itself, so results equal the library's.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .textvec import SEGMENT, as_bytes, word_spans

#: White space and separators other than the six ASCII ones: such texts are encoded whole.
_ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]|<\|")
#: Words of these characters only are split by _RUNS below; the library splits all others.
_PLAIN = re.compile(r"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The pre-tokeniser's alternatives for plain lower-case words.
_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Distinct words a worker remembers (about 40 MB); beyond it the memory is emptied, results stay the same.
REMEMBERED = 600_000


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _library(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _ranked(path: str, end: str):
    """The vocabulary as byte ranks, if each merge's rank is its place among the ids; ``end`` becomes the byte 1."""
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    vocab, added = spec["model"]["vocab"], {a["content"] for a in spec["added_tokens"]}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    ids = [vocab["".join(m)] for m in merges]
    if ids != sorted(ids) or spec["model"].get("ignore_merges"):
        return None
    byte, ranks = _byte_of(), {}
    for token, i in vocab.items():
        if token not in added:
            closed = bool(end) and token.endswith(end)
            ranks[bytes(byte[c] for c in (token[: -len(end)] if closed else token)) + b"\x01" * closed] = i
    # Fixed value: the pre-tokenisation pattern of byte-level vocabularies.
    pattern = r"[^\x01]+\x01" if end else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class WordIds:
    """Ids by a vocabulary with word ends."""

    def __init__(self, path: str):
        self.tok = _library(path)
        self.fast = _ranked(path, "</w>")
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.number = np.zeros(0, np.int64)  # of the word with that hash
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _word(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        if self.fast is not None and _PLAIN.fullmatch(text):
            return self.fast.encode_ordinary("\x01".join(_RUNS.findall(text.lower())) + "\x01")
        return self.tok.encode(text, add_special_tokens=False).ids

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        found = [self._word(w) for w in words]
        base = len(self.starts) - 1
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum([len(x) for x in found])])
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.number = np.insert(self.number, at, np.arange(base, base + len(words)))

    def _numbers(self, buf: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.hashes):
            new = self.hashes[np.minimum(at, len(self.hashes) - 1)] != distinct
        if new.any():
            spots = first[new]
            self._learn(distinct[new], [buf[s:e] for s, e in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, distinct)
        return self.number[at][inverse]

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and each word's number of ids."""
        n = self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.starts[numbers] - (ends - n), n)], n

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; nothing added, cut or padded."""
        out: list = [None] * len(texts)
        plain: list[int] = []
        for i, t in enumerate(texts):
            if t and _ODD.search(t):
                out[i] = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                plain.append(i)
        group: list[int] = []
        size = 0
        raw = as_bytes([texts[i] for i in plain])
        for j in [*range(len(plain)), None]:
            if group and (j is None or size + len(raw[j]) > SEGMENT):
                for g, ids in zip(group, self._encode_group([raw[g] for g in group]), strict=True):
                    out[plain[g]] = ids
                group, size = [], 0
            if j is not None:
                group.append(j)
                size += len(raw[j]) + 1
        return out

    def _encode_group(self, raw: list[bytes]) -> list[np.ndarray]:
        if len(raw) == 1 and len(raw[0]) > 2 * SEGMENT:  # a very long text: piece by piece
            from .textvec import pieces

            return [np.concatenate([self._encode_group([p])[0] for p in pieces(raw[0])])]
        buf = b"\n".join(raw)
        starts, ends, hashes = word_spans(np.frombuffer(buf, np.uint8))
        ids, n = self._gather(self._numbers(buf, starts, ends, hashes)) if len(starts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        before = np.concatenate([[0], np.cumsum(n)])
        cuts = before[np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in raw)]))]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class ByteCounts:
    """Token counts by a byte-level vocabulary; its special strings count as one token each, as the library does by default."""

    def __init__(self, path: str):
        self.tok = _library(path)
        self.fast = _ranked(path, "")
        special = [a["content"] for a in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.fast is None:
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(len(self.fast.encode_to_numpy(p, disallowed_special=())) for p in parts if p)


_MADE: dict = {}


def made(kind: type, path: str):
    """One encoder for a worker process, kind and file."""
    if (kind, path) not in _MADE:
        _MADE[kind, path] = kind(path)
    return _MADE[kind, path]
