"""Benchmark decontamination on canonical templates.

Texts become templates: numbers, units and names turn into typed placeholders, other words into hashes of their
small letters (A to Z and À to Þ are folded), punctuation around words goes.  Windows of five template tokens of the benchmark are the build side
of a hash join that each task probes with the windows of its documents; an item counts as found where a document holds
at least ``similarity`` of the item's distinct windows.  Then slots are compared: along the item's alignment in the
document, an item value must always turn into the same document value, as it does when a question is asked again with
other numbers or names.  Many mismatches mean that the template only looks alike.  Words with a capital at a sentence's
start are literals, and in a second, looser set of windows names: such a window counts where the words are equal or one of
them is a name in its text: it stands as one inside a sentence, or is no closed-class word and nowhere without its capital.
Windows of placeholders alone say nothing of a text, so no template window is without a literal.
A third set holds the plain words, whatever their case, so a copy in capitals is found, and so are items of numbers alone, with
their values.  Items of under five words are found by that set alone, in one window of their own width, word for word, and
only where they are half of a document's words or more: "yes" or "42" within a text is no copy of a question.

The build side is taken in blocks of at most ``block_windows`` windows, a pass over the documents for each block, so what
is broadcast is bounded whatever the benchmark's size.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shingles import U, Words, buffers, shingles, slices, stream
from spanloom.llm.tables import keep, map_arrow, text_or_empty

WIDTH, SIMILARITY, BLOCK_WINDOWS = 5, 0.8, 1_000_000
SHORT_SHARE = 0.5  # of a document's words, that an item of under WIDTH words must be
SHIFTS = 1024  # alignments that are compared at a time
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
_PLACEHOLDER = stream(4, 6)
# Units of measure and number words.
UNITS = """
mm millimeter millimeters millimetre millimetres cm centimeter centimeters centimetre centimetres dm m meter meters metre metres
km kilometer kilometers kilometre kilometres in inch inches ft foot feet yd yard yards mi mile miles
mg milligram milligrams g gram grams kg kilogram kilograms kilo kilos t tonne tonnes lb lbs oz pound pounds ounce ounces ton tons
ml cl l liter liters litre litres gallon gallons pint pints s sec secs second seconds min mins minute minutes h hr hrs hour hours
day days week weeks month months year years hz khz mhz ghz w kw mw j kj cal kcal v mv a ma pa kpa bar k c f mph kph
usd eur gbp dollar dollars cent cents euro euros percent degree degrees byte bytes kb mb gb tb
""".split()
NUMBER_WORDS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty
thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
""".split()
# Closed-class words, which are no names at a sentence's start.
CLOSED = """
a an the this that these those he she it we you they i his her its our your their my there here what which who whom whose when where why how
if in on at by for from of to with as and but or so then after before is are was were do does did can could will would each every all some no not
der die das ein eine er sie es wir ihr ich wer was wann wo warum wie wenn und aber oder im in am an auf mit von zu nach vor ist sind hat haben
le la les un une des il elle nous vous ils elles je qui que quoi quand comment pourquoi combien si et mais ou dans sur avec de pour par est sont
el los las una unos del al ella nosotros ellos yo quien cuando donde cuanto cuantos y pero o en con para por es son hay
""".split()


def _hashes(words: list[str]) -> np.ndarray:
    data, offs = buffers(pa.array(words, pa.string()))
    return np.sort(Words(data, offs).hash)


_UNIT_HASHES, _NUMBER_HASHES, _CLOSED_HASHES = _hashes(UNITS), _hashes(NUMBER_WORDS), _hashes(CLOSED)
_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_UP = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UP | ((_BYTE >= 97) & (_BYTE <= 122))
_WORDLIKE = _DIGIT | _UP | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_STOP = np.isin(_BYTE, np.frombuffer(b".!?:;", dtype=np.uint8))


@dataclass
class Template:
    """Tokens of consecutive texts: id (what windows compare), kind, value (hash of what a slot held), row.

    opening: a literal with a capital at a sentence's start.  names: (row, hash) of each capitalised word inside a sentence.
    words: (row, hash) of every word, in order, before names in a row became one; word_counts: how many each text has."""

    ids: np.ndarray
    kinds: np.ndarray
    values: np.ndarray
    row: np.ndarray
    counts: np.ndarray
    opening: np.ndarray
    names: tuple[np.ndarray, np.ndarray]
    words: tuple[np.ndarray, np.ndarray]
    word_counts: np.ndarray

    def loose_ids(self) -> np.ndarray:
        """ids with openings as names."""
        return np.where(self.opening, _PLACEHOLDER[NAME], self.ids)

    def named(self, row: int, lo: int, hi: int) -> np.ndarray:
        """Which of the tokens [lo, hi) of ``row``, all of its tokens, are names, or openings that may be: a name elsewhere in
        the text, or no closed-class word and nowhere in the text without its capital."""
        a, b = np.searchsorted(self.names[0], [row, row + 1])
        values, opening = self.values[lo:hi], self.opening[lo:hi]
        small = values[(self.kinds[lo:hi] == LITERAL) & ~opening]
        likely = np.isin(values, self.names[1][a:b]) | ~np.isin(values, _CLOSED_HASHES) & ~np.isin(values, small)
        return (self.kinds[lo:hi] == NAME) | opening & likely


def _folded(data: np.ndarray) -> np.ndarray:
    """The bytes with the Latin capitals À to Þ as small letters; A to Z are folded by the word hashes."""
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    upper = lead[(after >= 0x80) & (after <= 0x9E) & (after != 0x97)] + 1
    if not len(upper):
        return data
    out = data.copy()
    out[upper] += 0x20
    return out


def _no_tokens(n_rows: int) -> Template:
    none, no_hash, zero = np.empty(0, dtype=np.int64), np.empty(0, dtype=U), np.zeros(n_rows, dtype=np.int64)
    return Template(no_hash, none, no_hash, none, zero, none.astype(bool), (none, no_hash), (none, no_hash), zero)


def _unit_starts(words: Words, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where a unit begins that is glued to a number's digits, as in 60km; the end of each other word."""
    at = end.copy()
    numeric = _DIGIT[data[start]]
    while True:
        back = numeric & _LETTER[data[at - 1]]
        if not back.any():
            break
        at[back] -= 1
    split = numeric & (at < end)
    unit = np.zeros(len(start), dtype=bool)
    unit[split] = np.isin(words.span_hash(at[split], end[split]), _UNIT_HASHES)
    return np.where(unit, at, end)


def templates(data: np.ndarray, offsets: np.ndarray) -> Template:
    """A word's core is what is left without punctuation around it; words without a core are left out.

    A core that starts with a digit, or is a number word, is a number; one in UNITS right after a number, or glued to its
    digits, is a unit; one with a capital followed by no capital, not at a sentence's start, is a name.  Names in a row are one name."""
    words = Words(_folded(data), offsets)
    n_rows = len(offsets) - 1
    if not len(words.start):
        return _no_tokens(n_rows)
    start, end = words.start.copy(), words.end.copy()
    while True:
        lead = (start < end) & ~_WORDLIKE[data[np.minimum(start, len(data) - 1)]]
        if not lead.any():
            break
        start[lead] += 1
    while True:
        trail = (start < end) & ~_WORDLIKE[data[end - 1]]
        if not trail.any():
            break
        end[trail] -= 1
    tail = data[np.maximum(words.end - 1, 0)]
    stops = _STOP[tail]
    for back in (2, 3):  # closing quotes, or marks, after the full stop
        at = np.maximum(words.end - back, words.start)
        stops |= _STOP[data[at]] & (at >= end)
    opens = np.ones(len(start), dtype=bool)
    opens[1:] = stops[:-1] | (words.row[1:] != words.row[:-1])
    has = start < end
    start, end, row, opens = start[has], end[has], words.row[has], opens[has]
    if not len(start):
        return _no_tokens(n_rows)
    plain, plain_row = words.span_hash(start, end), row
    cut = _unit_starts(words, data, start, end)
    glued = np.flatnonzero(cut < end)
    start, end = np.insert(start, glued + 1, cut[glued]), np.insert(cut, glued + 1, end[glued])
    row, opens = np.insert(row, glued + 1, row[glued]), np.insert(opens, glued + 1, False)
    value = words.span_hash(start, end)
    first = data[start]
    second = data[np.minimum(start + 1, end - 1)]
    latin = (first == 0xC3) & (end - start > 1)
    capital = _UP[first] | latin & (second >= 0x80) & (second <= 0x9E)
    after = data[np.minimum(start + np.where(latin, 2, 1), end - 1)]
    after2 = data[np.minimum(start + np.where(latin, 3, 2), end - 1)]
    shout = (end - start > 1 + latin) & (_UP[after] | (after == 0xC3) & (after2 >= 0x80) & (after2 <= 0x9E))
    kinds = np.full(len(start), LITERAL)
    kinds[capital & ~shout & ~opens] = NAME
    number = _DIGIT[first] | np.isin(value, _NUMBER_HASHES)
    kinds[number] = NUMBER
    behind = np.zeros(len(start), dtype=bool)
    behind[1:] = number[:-1] & (row[1:] == row[:-1])
    kinds[behind & ~number & np.isin(value, _UNIT_HASHES)] = UNIT
    opening = capital & ~shout & opens & (kinds == LITERAL)
    inside = kinds == NAME
    names = row[inside], value[inside]
    more = np.zeros(len(start), dtype=bool)
    more[1:] = (kinds[1:] == NAME) & (kinds[:-1] == NAME) & (row[1:] == row[:-1])
    if more.any():
        lead = np.flatnonzero(~more)
        value = np.add.reduceat(value, lead)
        kinds, row, opening = kinds[lead], row[lead], opening[lead]
    ids = np.where(kinds == LITERAL, value, _PLACEHOLDER[kinds])
    return Template(ids, kinds, value, row, np.bincount(row, minlength=n_rows), opening, names, (plain_row, plain), np.bincount(plain_row, minlength=n_rows))


@dataclass
class Index:
    """Windows of a block, sorted for probing."""

    keys: np.ndarray  # sorted distinct window hashes
    opens: np.ndarray  # where each key's postings begin
    item: np.ndarray  # of each posting
    at: np.ndarray  # token of the item
    window: np.ndarray  # number of the exact window there
    sieve: np.ndarray

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of ``h`` that are found, their keys)."""
        maybe = np.flatnonzero(self.sieve[h & U((1 << 22) - 1)])
        key = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        real = self.keys[key] == h[maybe]
        return maybe[real], key[real]

    def windows(self, keys: np.ndarray) -> np.ndarray:
        """Distinct (item, window) of ``keys``."""
        own = np.unique(keys)
        lens = self.opens[own + 1] - self.opens[own]
        post = np.repeat(self.opens[own] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
        return np.unique(np.stack([self.item[post], self.window[post]], axis=1), axis=0)

    def places(self, item: int, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rows of (place, item token, window) for the places ``at`` with ``keys``."""
        own, which = np.unique(keys, return_inverse=True)
        span = np.array([np.searchsorted(self.item[self.opens[k] : self.opens[k + 1]], [item, item + 1]) + self.opens[k] for k in own.tolist()], dtype=np.int64).reshape(-1, 2)
        lens = (span[:, 1] - span[:, 0])[which]
        post = np.repeat(span[which, 0] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        return np.stack([np.repeat(at, lens), self.at[post], self.window[post]], axis=1)


def _index(h: np.ndarray, owner: np.ndarray, at: np.ndarray, window: np.ndarray) -> Index:
    order = np.lexsort((owner, h))
    keys, opens = np.unique(h[order], return_index=True)
    sieve = np.zeros(1 << 22, dtype=bool)
    sieve[keys & U((1 << 22) - 1)] = True
    return Index(keys, np.append(opens, len(h)), owner[order], at[order], window[order], sieve)


@dataclass
class Block:
    """A block of benchmark items: exact windows, loose ones in which openings are names, and windows of plain words.

    widths: those of the plain windows, five and the number of words of each shorter item."""

    item_ids: list[int]
    first: np.ndarray  # of each item's tokens
    tokens: Template
    n_windows: np.ndarray  # distinct exact ones, by item
    exact: Index
    loose: Index
    plain: Index
    n_plain: np.ndarray  # distinct plain windows, by item
    widths: list[int]

    def n_words(self, item: int) -> int:
        return int(self.tokens.word_counts[item])


def _distinct_windows(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    pairs = np.unique(np.stack([owner.astype(U), h], axis=1), axis=0) if len(h) else np.empty((0, 2), dtype=U)
    return np.bincount(pairs[:, 0].astype(np.int64), minlength=n)


def build_block(item_ids: list[int], texts: list[str]) -> Block:
    data, offs = buffers(pa.array(texts, pa.large_string()))
    t = templates(data, offs)
    h, owner = shingles(t.ids, t.row, t.counts, WIDTH)
    begins = np.searchsorted(owner, np.arange(len(texts)))
    at = np.arange(len(h)) - begins[owner] if len(h) else np.empty(0, dtype=np.int64)
    window = np.unique(h, return_inverse=True)[1]
    first = np.concatenate(([0], np.cumsum(t.counts)))

    def literal(tokens: np.ndarray) -> np.ndarray:
        """Which windows hold one of ``tokens``."""
        sums = np.concatenate(([0], np.cumsum(tokens)))
        begin = first[owner] + at
        return sums[np.minimum(begin + WIDTH, first[owner + 1])] > sums[begin]

    plain_words = t.kinds == LITERAL
    some, more = literal(plain_words), literal(plain_words & ~t.opening)
    n_windows = _distinct_windows(h[some], owner[some], len(texts))
    exact = _index(h[some], owner[some], at[some], window[some])
    loose = _index(shingles(t.loose_ids(), t.row, t.counts, WIDTH)[0][more], owner[more], at[more], window[more])
    g, of = shingles(t.words[1], t.words[0], t.word_counts, WIDTH)
    plain = _index(g, of, np.zeros(len(g), dtype=np.int64), np.unique(g, return_inverse=True)[1])
    widths = np.unique(np.minimum(t.word_counts[t.word_counts > 0], WIDTH)).tolist()
    return Block(item_ids, first, t, n_windows, exact, loose, plain, _distinct_windows(g, of, len(texts)), widths)


def _align(at: np.ndarray, n_item: int, n_doc: int, main: int) -> list[tuple[int, int]]:
    """(item token, document token), one-to-one and in order, for windows that start at the places ``at``.

    Tokens on the main shift come first; the nearest other shifts only fill item tokens that are still uncovered."""
    image: dict[int, int] = {}
    covered: list[int] = []
    shift = at[:, 1] - at[:, 0]
    for d in sorted(np.unique(shift).tolist(), key=lambda d: (abs(d - main), d)):
        starts = at[shift == d, 0]
        for i in np.unique((starts[:, None] + np.arange(WIDTH)).ravel()).tolist():
            k = i + d
            if i in image or not 0 <= i < n_item or not 0 <= k < n_doc:
                continue
            j = bisect_left(covered, i)
            if (j == 0 or image[covered[j - 1]] < k) and (j == len(covered) or k < image[covered[j]]):
                image[i] = k
                covered.insert(j, i)
    return [(i, image[i]) for i in covered]


def _slots(block: Block, item: int, t: Template, row: int, base: int, doc_at: np.ndarray, item_at: np.ndarray, loose: bool = False) -> tuple[int, int, int]:
    """(slots, changed, broken) along the most frequent alignment of the item in the document; of several equally
    frequent ones, the one with the smallest share of broken slots.  loose: openings are slots where they are names in the
    item, or differ."""
    shift = doc_at - item_at
    d, n = np.unique(shift, return_counts=True)
    lo, hi = int(block.first[item]), int(block.first[item + 1])
    mine, n_doc = block.tokens, int(t.counts[row])
    named = mine.named(item, lo, hi)
    main = _straightest(block, lo, hi, t, base, n_doc, d[n == n.max()])
    near = np.abs(shift - main) <= WIDTH
    # the indexes hold no windows of placeholders alone: those of the main shift are read off the tokens
    i = np.arange(hi - lo)
    equal = (i + main >= 0) & (i + main < n_doc)
    equal &= mine.ids[lo:hi] == t.ids[base + np.clip(i + main, 0, n_doc - 1)]
    bare = np.flatnonzero(np.convolve(equal, np.ones(WIDTH, dtype=np.int64), "valid") == WIDTH) if hi - lo >= WIDTH else i[:0]
    at = np.concatenate([np.stack([item_at[near], doc_at[near]], axis=1), np.stack([bare, bare + main], axis=1)])
    at = np.unique(at, axis=0)
    image: dict[tuple[int, int], int] = {}
    slots = changed = broken = 0
    for i, k in _align(at, hi - lo, n_doc, main):
        kind, other = int(mine.kinds[lo + i]), int(t.kinds[base + k])
        a, b = int(mine.values[lo + i]), int(t.values[base + k])
        if loose:
            if mine.opening[lo + i] and (named[i] or a != b):
                kind = NAME
            if t.opening[base + k]:
                other = NAME
        if kind == LITERAL or kind != other:
            continue
        slots += 1
        changed += a != b
        broken += image.setdefault((kind, a), b) != b
    return slots, changed, broken


def _straightest(block: Block, lo: int, hi: int, t: Template, base: int, n_doc: int, shifts: np.ndarray) -> int:
    """Of equally frequent shifts the one with the smallest share of broken slots along the straight alignment, then the
    smallest; shifts are compared as rows of a matrix, so a text that repeats itself costs no loop."""
    if len(shifts) == 1:
        return int(shifts[0])
    kinds, values = block.tokens.kinds[lo:hi], block.tokens.values[lo:hi]
    slot_at = np.flatnonzero(kinds != LITERAL)
    if not len(slot_at):
        return int(shifts[0])
    _, first, same = np.unique(values[slot_at] + kinds[slot_at].astype(U), return_index=True, return_inverse=True)
    best, most = int(shifts[0]), 2.0
    for c in range(0, len(shifts), SHIFTS):
        k = shifts[c : c + SHIFTS, None] + slot_at
        inside = (k >= 0) & (k < n_doc)
        k = base + np.clip(k, 0, n_doc - 1)
        slot = inside & (t.kinds[k] == kinds[slot_at])
        seen = t.values[k]
        broken = slot & slot[:, first[same]] & (seen != seen[:, first[same]])
        share = broken.sum(axis=1) / np.maximum(1, slot.sum(axis=1))
        i = int(share.argmin())
        if share[i] < most:
            best, most = int(shifts[c + i]), float(share[i])
    return best


def _same(block: Block, item: int, t: Template, row: int, base: int, places: np.ndarray) -> np.ndarray:
    """Which loose matches hold: tokens that differ exactly must be one word, or a name in one of the texts."""
    lo, hi = int(block.first[item]), int(block.first[item + 1])
    n_doc = int(t.counts[row])
    mine, other = block.tokens.named(item, lo, hi), t.named(row, base, base + n_doc)
    ok = np.ones(len(places), dtype=bool)
    for j in range(min(WIDTH, hi - lo)):
        i, k = places[:, 1] + j, places[:, 0] + j
        a, b = lo + i, base + k
        ok &= (block.tokens.ids[a] == t.ids[b]) | (block.tokens.values[a] == t.values[b]) | mine[i] | other[k]
    return ok


def find_in(data: np.ndarray, offsets: np.ndarray, block: Block, similarity: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(row, item position, share of windows found, windows of the item, slots, changed) for every item found.

    Exact windows come first; where they do not settle it, windows count too that differ in names at a sentence's start;
    last come the plain words, without slots."""
    t = templates(data, offsets)
    h, owner = shingles(t.ids, t.row, t.counts, WIDTH)
    if not len(h) or not len(block.plain.keys):
        return
    rows3, key3 = _plain_hits(t, block)
    at1, key1 = block.exact.probe(h)
    at2, key2 = block.loose.probe(shingles(t.loose_ids(), t.row, t.counts, WIDTH)[0])
    del h
    begins = np.searchsorted(owner, np.arange(len(offsets)))
    firsts = np.concatenate(([0], np.cumsum(t.counts)))
    rows1, rows2 = owner[at1], owner[at2]
    for row in np.unique(np.concatenate([rows1, rows2, rows3])).tolist():
        one, two = slice(*np.searchsorted(rows1, [row, row + 1])), slice(*np.searchsorted(rows2, [row, row + 1]))
        base, begin = int(firsts[row]), int(begins[row])
        exact = block.exact.windows(key1[one])
        items, n = np.unique(exact[:, 0], return_counts=True)
        share = dict(zip(items.tolist(), (n / block.n_windows[items]).tolist(), strict=True))
        items, n = np.unique(np.unique(np.concatenate([exact, block.loose.windows(key2[two])]), axis=0)[:, 0], return_counts=True)
        done: set[int] = set()
        for item in items[n / block.n_windows[items] >= similarity].tolist():
            if block.n_words(item) < WIDTH:
                continue  # left to the plain words
            windows = int(block.n_windows[item])
            places = block.exact.places(item, at1[one] - begin, key1[one])
            if share.get(item, 0.0) >= similarity:
                slots, changed, broken = _slots(block, item, t, row, base, places[:, 0], places[:, 1])
                if not broken_too_often(slots, broken):
                    done.add(item)
                    yield row, item, share[item], windows, slots, changed
                    continue
            more = block.loose.places(item, at2[two] - begin, key2[two])
            every = np.unique(np.concatenate([places, more[_same(block, item, t, row, base, more)]]), axis=0)
            s = len(np.unique(every[:, 2])) / windows
            if s >= similarity:
                slots, changed, broken = _slots(block, item, t, row, base, every[:, 0], every[:, 1], True)
                if not broken_too_often(slots, broken):
                    done.add(item)
                    yield row, item, s, windows, slots, changed
        items, n = np.unique(block.plain.windows(key3[slice(*np.searchsorted(rows3, [row, row + 1]))])[:, 0], return_counts=True)
        for item, found in zip(items.tolist(), n.tolist(), strict=True):
            short = block.n_words(item) < WIDTH and block.n_words(item) < SHORT_SHARE * t.word_counts[row]
            if item not in done and not short and found >= similarity * block.n_plain[item]:
                yield row, item, found / int(block.n_plain[item]), int(block.n_plain[item]), 0, 0


def _plain_hits(t: Template, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys) of the documents' windows of plain words that the block has, in row order."""
    rows, keys = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for width in block.widths:
        h, owner = shingles(t.words[1], t.words[0], t.word_counts, width)
        at, key = block.plain.probe(h)
        rows.append(owner[at])
        keys.append(key)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(row, kind="stable")
    return row[order], key[order]


def broken_too_often(slots: int, broken: int) -> bool:
    """More than a fifth of an alignment's slots contradict an earlier one."""
    return 5 * broken > slots


def blocks(benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, by item_id; null texts are empty and match nothing."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long"), text_or_empty().alias("text")).orderBy("item_id", "text").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += r.text.count(" ") + r.text.count("\n") + 1
        if size >= block_windows:
            yield build_block(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield build_block(ids, texts)


def _matches(shared, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offs = buffers(batch.column(1))
            out: list[tuple] = []
            for a, b in slices(offs):
                for row, item, s, windows, slots, changed in find_in(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], block, similarity):
                    out.append((ids[a + row], block.item_ids[item], s, windows, slots, changed))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "similarity", "n_windows", "n_slots", "n_changed"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, item_id, similarity, n_windows, n_slots, n_changed: a row for every item found in a row of ``docs``.

    similarity: the share of the item's distinct windows (n_windows) that the document has.  n_slots and n_changed are 0
    for items found by their plain words.  Items of under five words are found anywhere, but only word for word.  Null and
    empty texts and items hold and match nothing; repeated rows of ``docs`` give repeated rows, equal items one row each;
    very long texts are searched whole; a null doc_id is passed on; an empty table gives no rows.  Other columns, clashing
    ones too, are not read.

    With several blocks each one's hits are written before the next is broadcast, so that one is in memory at a time."""
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    schema = "doc_id long, item_id long, similarity double, n_windows long, n_slots long, n_changed long"
    parts: list[DataFrame] = []
    for part in _each_block(docs, benchmark, block_windows, lambda shared, _: map_arrow(rows, _matches(shared, similarity), schema)):
        parts.append(part)
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def _each_block(docs: DataFrame, benchmark: DataFrame, block_windows: int, step) -> Iterator[DataFrame]:
    """``step`` (shared block, what it gave before) for each block; all but the last are written and their block freed."""
    shared, out = None, None
    for block in blocks(benchmark, block_windows):
        if out is not None:
            out = keep(out)
            shared.destroy()
            yield out
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = step(shared, out)
    if out is not None:
        yield out


def _clean(shared, similarity: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            data, offs = buffers(pc.fill_null(batch.column(text_at), ""))
            keep = np.ones(batch.num_rows, dtype=bool)
            for a, b in slices(offs):
                for row, *_ in find_in(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], block, similarity):
                    keep[a + row] = False
            yield batch.filter(pa.array(keep))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; a pass for each block, without a shuffle.

    Columns keep their names, types and order, clashing ones too; null and empty texts stay; repeated rows stay or go
    together; very long texts are searched whole; an empty benchmark drops nothing."""
    cols = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    schema, out = plain.schema, plain
    for out in _each_block(docs, benchmark, block_windows, lambda shared, before: map_arrow(plain if before is None else before, _clean(shared, similarity, cols.index("text")), schema)):
        pass
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
