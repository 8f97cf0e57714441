"""Secret scans: fixed patterns, and sliding-window Shannon entropy for each character class.

Fixed kinds find the usual shapes (assignments, access keys, hex runs).  The entropy kind takes candidate strings of
base-64 and hex characters and slides a window over each: the window's character counts and the sum of c*log2(c) are
updated in O(1) a step, and a window whose entropy reaches its class's threshold is secret-like.  Overlapping windows
merge.  A run shorter than the window, of at least SHORTEST characters, is its own window, with the threshold scaled by its
greatest possible entropy.  The allow-list suppresses entropy findings only; fixed kinds stay.  Its words hide only the
piece between delimiters that they are in.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tables import map_arrow, text_or_empty

KINDS = ("assign", "access", "hex", "entropy")
# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINT = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SHORTEST = 20
PIECE = re.compile(r"[^/_=+-]+")
# Strings that look random and are not secret (identifiers, digests with a prefix, placeholders).
WORDS = r"(?i:.*(example|sample|placeholder|xxxxx|0123456789|abcdefghij).*)"
ALLOW = (
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"[-_=+/]+",
    r"[0-9]+",
    WORDS,
    r"(?i:(https?|www)[-_/].*)",
)


@dataclass(frozen=True)
class CharClass:
    """A window of ``window`` characters, all in ``chars``, is secret-like at ``bits`` of entropy."""

    name: str
    chars: frozenset[str]
    window: int
    bits: float


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharClass("hex", frozenset(_DIGITS + "abcdefABCDEF"), 24, 3.1),
    CharClass("alnum_lower", frozenset(_DIGITS + _LOWER), 24, 3.9),
    CharClass("base64", frozenset(_DIGITS + _LOWER + _UPPER + "+/_=-"), 24, 4.0),
)
_TERM = [0.0] + [c * math.log2(c) for c in range(1, 4097)]


def entropy_windows(text: str, window: int, bits: float) -> Iterator[tuple[int, int]]:
    """Merged spans of the windows of ``text`` whose Shannon entropy is at least ``bits``."""
    n = len(text)
    if n < window:
        return
    counts: dict[str, int] = {}
    total = 0.0
    base = math.log2(window)
    open_at = close = -1
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        total += _TERM[c + 1] - _TERM[c]
        counts[ch] = c + 1
        if i >= window:
            old = text[i - window]
            c = counts[old]
            total += _TERM[c - 1] - _TERM[c]
            counts[old] = c - 1
        if i >= window - 1 and base - total / window >= bits - 1e-9:
            if open_at < 0 or i - window + 1 > close:
                if open_at >= 0:
                    yield open_at, close
                open_at = i - window + 1
            close = i + 1
    if open_at >= 0:
        yield open_at, close


def _runs(text: str, chars: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Maximal runs of ``chars``."""
    at = -1
    for i, ch in enumerate(text):
        if ch in chars:
            at = i if at < 0 else at
        elif at >= 0:
            yield at, i
            at = -1
    if at >= 0:
        yield at, len(text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed kinds: leftmost, non-overlapping within a kind, failing ones dropped."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINT):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def entropy_spans(text: str, classes: Iterable[CharClass] = CLASSES, allow: tuple[re.Pattern, re.Pattern] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of secret-like windows.  A candidate needs a digit and a letter; a candidate, or a
    finding, that the allow-list matches in full is suppressed, and a piece of it that the words match ends its runs."""
    whole, words = allow or _ALLOW
    found: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        word = m[0]
        if not any(c in _DIGITS for c in word) or not any(c.isalpha() for c in word) or whole.fullmatch(word):
            continue
        word = PIECE.sub(lambda p: " " * len(p[0]) if words.fullmatch(p[0]) else p[0], word)
        for kind in classes:
            for a, b in _runs(word, kind.chars):
                if b - a < SHORTEST:
                    continue
                window = min(kind.window, b - a)
                for s, e in entropy_windows(word[a:b], window, kind.bits * math.log2(window) / math.log2(kind.window)):
                    piece = word[a + s : a + e]
                    if any(c in _DIGITS for c in piece) and any(c.isalpha() for c in piece) and not whole.fullmatch(piece):
                        found.append((m.start() + a + s, m.start() + a + e))
    merged: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return [(s, 3, e) for s, e in merged]


def allowed(allow: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern]:
    """(patterns for a whole candidate or finding, those for a piece between delimiters)."""
    parts = [x for x in allow if x != WORDS], [x for x in allow if x == WORDS]
    whole, words = (re.compile("|".join(f"(?:{x})" for x in p) or r"(?!)") for p in parts)
    return whole, words


_ALLOW = allowed(ALLOW)


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(allow: tuple[str, ...], found_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = allowed(allow)
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for text in batch.column(1):
                t = text.as_py()
                base = base_spans(t)
                every = sorted(base + entropy_spans(t, CLASSES, pattern))
                for c, k in zip(cols[:3], range(3), strict=True):
                    c.append(sum(1 for x in base if x[1] == k))
                cols[3].append(hashlib.sha256(render(base).encode()).hexdigest())
                cols[4].append(render(every))
                if found_too:
                    cols[5].append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every])
            found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:5])]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(cols[5], found)] if found_too else []), names + (["found"] if found_too else []))

    return run


def find_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW, found: bool = True) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and if asked found (array of kind, start, end) for every row.

    Null and empty texts hold nothing; rows are independent of each other, so repeats give equal rows; very long texts are
    scanned whole, in time that grows with their length; spans that start together are told in the order of the kinds; an
    empty table gives an empty table; other columns, clashing ones too, are not read."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + (", found array<struct<kind:string,start:long,end:long>>" if found else "")
    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), _scan(tuple(allow), found), schema)


def redact(text: str, mark: str = "[secret]") -> str:
    """``text`` with every finding replaced; overlapping findings are replaced once."""
    out, at = [], 0
    for s, _, e in sorted(base_spans(text) + entropy_spans(text)):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]
