"""Secret scans with multipart credential linking.

Three base patterns find single-part secrets. Beyond them, a credential often comes in parts that
are weak alone: an access identifier, a secret, an endpoint. All parts of a text are found, each
identifier or access key opens a scope (an interval of ``REACH`` code points on either side, cut at
blank lines), and an interval join by binary search links the parts whose starts lie in a common
scope. A weak candidate (a bare 32 to 64 character string of mixed classes, a user name, a client
id, an endpoint) is reported only when complementary parts co-occur: a bare secret or a base
``assign`` match with an identifier.

Defined results: a null text counts as empty; empty texts have no spans; a null ``doc_id`` is carried
on; repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: The base kinds in order, with their patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "identifier", "weak_secret", "endpoint"]
#: Code points between a part and the anchor it may belong to.
REACH = 300

_IDENTIFIER = re.compile(r"""\b(?:client_?id|account(?:_?id)?|user(?:name)?|login|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+_.-]{3,}""", re.I | re.A)
_ENDPOINT = re.compile(r"\b(?:https?|s3|gs|wss?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9][A-Za-z0-9._:/@-]*|\b(?:host|endpoint|region)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9][A-Za-z0-9.:-]{2,}", re.I | re.A)
_BARE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{32,64}={0,2}(?![A-Za-z0-9+/_=.-])")
_BLANK = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, sorted; ends are exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that complementary parts in their scope make a credential."""
    identifiers = [(m.start(), 3, m.end()) for m in _IDENTIFIER.finditer(text)]
    anchors = sorted([*identifiers, *(b for b in base if b[1] == 1)])
    if not anchors:
        return []
    starts, reach = [b[0] for b in base], list(accumulate((b[2] for b in base), max))

    def free(start: int, end: int) -> bool:
        """No base match that starts before ``end`` goes beyond ``start``."""
        i = bisect_left(starts, end)
        return not i or reach[i - 1] <= start

    weak = [(m.start(), 4, m.end()) for m in _BARE.finditer(text) if _mixed(m[0]) and free(m.start(), m.end())]
    secrets = sorted([*weak, *(b for b in base if b[1] != 1)])
    if not secrets:
        return []
    endpoints = [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    blanks = [m.start() for m in _BLANK.finditer(text)]
    at_secret, at_endpoint, out = [s[0] for s in secrets], [e[0] for e in endpoints], set()
    for start, kind, end in anchors:
        i = bisect_left(blanks, start)
        low = max(start - REACH, blanks[i - 1] if i else 0)
        high = min(end + REACH, blanks[i] if i < len(blanks) else len(text) + 1)
        near = secrets[bisect_left(at_secret, low) : bisect_left(at_secret, high)]
        if near:
            out.update(x for x in near if x[1] == 4)
            out.update(endpoints[bisect_left(at_endpoint, low) : bisect_left(at_endpoint, high)])
            if kind == 3:
                out.add((start, kind, end))
    return sorted(out)


def _mixed(s: str) -> bool:
    """Digits and letters of both cases: what random base64 of 32 and more characters nearly always has."""
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    every = sorted([*base, *linked_spans(text, base)])
    return (*n, joined(base), joined(every))


def _scan_all(texts: list[str]) -> dict[str, list]:
    return dict(zip(["n_assign", "n_access", "n_hex", "base", "spans"], map(list, zip(*map(scan, texts), strict=True)), strict=True))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base (the base spans), spans (all spans).

    A span is kind:start:end in code points of the whole text, end exclusive.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, _scan_all, "n_assign long, n_access long, n_hex long, base string, spans string")


def secret_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: the base spans as their SHA-256."""
    return find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
