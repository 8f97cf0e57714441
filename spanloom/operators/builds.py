"""Building annotation sets from several sources: rule voters, re-extracted items, laboratory items, drafts, reports."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.operators import bloom
from spanloom.operators import edits as E
from spanloom.operators import linking as K
from spanloom.operators.locate import beside, loose_occurrences, loosened, occurrences
from spanloom.operators.records import range_ranks, short_term, systematic_sample
from spanloom.operators.spans import islands
from spanloom.operators.structure import parse_lines
from spanloom.sources.shared import keep

LAB_TYPES = (vocab.LAB_NAME, vocab.LAB_RESULT)


def with_rank(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` numbered from 1 in ``order``, which must be unique."""
    return range_ranks(rows, order, name).withColumn(name, F.col(name) + 1).drop("_total")


def rule_votes(spans: DataFrame, docs: DataFrame, voter: str = "rule") -> DataFrame:
    """Extracted spans as one more voter's requests: text, type, the first label, and the 15 characters before."""
    before = F.expr(f"substring(body, greatest(start - {vocab.CONTEXT_LEN}, 0) + 1, least({vocab.CONTEXT_LEN}, start))")
    first = F.slice("assertions", 1, 1)
    order = Window.partitionBy("doc_id").orderBy("start", "end", "type")
    return spans.join(docs, "doc_id").select("doc_id", F.lit(voter).alias("voter"), F.row_number().over(order).alias("item_ord"), "text", "type", first.alias("assertions"), before.alias("before"))


# ---- items that are located one after another, each taking its place

_PLACED = "doc_id bigint, item_ord int, start int, end int"
LEAST_SUFFIX = 3
_BEFORE = 15


def context_candidates(items: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, item_ord, rank, start, end: the places of each text, ranked by how much of the end of ``before`` stands there
    (rank is that length, negative)."""
    longest = items.agg(F.max(F.length("before"))).first()[0] or 1
    at = items.join(occurrences(items, docs, nfc_fallback=False, width=longest), ["doc_id", "text"])
    # what stands before a place comes with the place: cut out of the body here, it would be counted to from the body's start for each n
    at = at.withColumn("_led", F.expr("right(left, length(before))"))
    same = F.expr("size(filter(sequence(1, greatest(length(before), 1)), n -> n <= length(before) and right(_led, n) = right(before, n)))")
    return at.select("doc_id", "item_ord", (-same).alias("rank"), "start", "end")


def ladder_candidates(items: DataFrame, docs: DataFrame) -> DataFrame:
    """As ``context_candidates``, with four ranks: the first place right after ``before`` (its last 15 characters), other
    places word for word, then with case and gaps let go, right after ``before`` and anywhere.  Texts of one or two characters
    have no places of the last rank.  Ends of texts and of ``before`` are trimmed."""
    before = F.trim(F.expr(f"right(before, {_BEFORE})"))
    loose = F.pandas_udf(lambda s: s.map(lambda t: loosened(t)[0].strip(" ")), "string")
    asked = items.select("doc_id", "item_ord", F.trim("text").alias("text"), before.alias("_b"), loose(before).alias("_lb"))
    exact = asked.join(occurrences(asked, docs, nfc_fallback=False, width=_BEFORE), ["doc_id", "text"])
    exact = exact.withColumn("_led", (F.col("_b") != "") & F.endswith("left", F.col("_b"))).select("doc_id", "item_ord", "start", "end", "_led")
    led = F.col("_led")
    first = F.min(F.when(led, F.col("start"))).over(Window.partitionBy("doc_id", "item_ord"))
    exact = exact.select("doc_id", "item_ord", F.when(led & (F.col("start") == first), 0).otherwise(1).alias("rank"), "start", "end")
    near = asked.join(loose_occurrences(asked, docs), ["doc_id", "text"])
    rank = F.when((F.col("_lb") != "") & F.endswith("led", F.col("_lb")), 2).when(F.length("text") > 2, 3)
    return exact.unionByName(near.select("doc_id", "item_ord", rank.alias("rank"), "start", "end").filter("rank is not null"))


def _turns(unique: bool):
    """Rows (doc_id, item_ord, rank, start, end) come by document, taken spans first (item_ord null), then the places of each
    item by rank.  Each item takes its first free place; if ``unique``, only one that its rank singles out."""

    def chosen(free: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
        if not free or unique and len(free) > 1 and not (free[0][0] <= -LEAST_SUFFIX and free[0][0] < free[1][0]):
            return None
        return free[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, item, starts, ends, free = None, None, [], [], []

        def turn(out: list) -> None:
            if (got := chosen(free)) is not None:
                at = bisect_right(starts, got[1])
                starts.insert(at, got[1])
                ends.insert(at, got[2])
                out.append((doc, item, got[1], got[2]))

        for batch in chain(batches, [None]):  # the last turn comes after the last row
            out: list[tuple] = []
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch is not None else [(None, None, None, None, None)]
            for d, i, rank, s, e in rows:
                if (d, i) != (doc, item):
                    turn(out)
                    if d != doc:
                        starts, ends = [], []
                    doc, item, free = d, i, []
                if i is None and s is not None:
                    starts.append(s)
                    ends.append(e)
                elif s is not None:
                    at = bisect_right(starts, s)
                    if (at == 0 or ends[at - 1] <= s) and (at == len(starts) or starts[at] >= e):
                        free.append((rank, s, e))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_ord", "start", "end"), r, strict=True)) for r in out], schema=_TURN)

    return run


_TURN = pa.schema([("doc_id", pa.int64()), ("item_ord", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def place_items(items: DataFrame, base: DataFrame, docs: DataFrame, candidates: Callable = context_candidates) -> DataFrame:
    """doc_id, item_ord, start, end, reason for items (doc_id, item_ord, text, before, at), in order: each takes a place that
    neither the base nor an earlier item has.  ``at`` is a known start, or null.  reason: placed, wrong place, not found.

    By ``context_candidates`` an item is placed where one place is free, or where more of its ``before`` stands than at any
    other free place, LEAST_SUFFIX characters at least; by ``ladder_candidates`` at the free place of the best rank.
    Places are found and ranked by joins; only the turns are a sequence, streamed by document with its taken bounds in memory."""
    known = items.filter("at is not null").join(docs, "doc_id").filter("text <> '' and substring(body, at + 1, length(text)) = text")
    known = known.select("doc_id", "item_ord", F.lit(0).alias("rank"), F.col("at").alias("start"), (F.col("at") + F.length("text")).cast("int").alias("end"))
    ranked = candidates(items.filter("at is null and text <> ''").withColumn("before", F.coalesce("before", F.lit(""))), docs)
    # bases may overlap themselves: their islands are what is taken
    taken = islands(base.select("doc_id", "start", "end"), ["doc_id"]).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    none = F.lit(None).cast("int")
    rows = known.unionByName(ranked).unionByName(taken.select("doc_id", none.alias("item_ord"), none.alias("rank"), "start", "end"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in ("item_ord", "rank", "start", "end")])
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", F.asc_nulls_first("item_ord"), "rank", "start", "end")
    placed = rows.mapInArrow(_turns(candidates is context_candidates), _PLACED)
    lost = F.when(F.col("at").isNotNull(), "wrong place").otherwise("not found")
    told = items.select("doc_id", "item_ord", "at").join(placed, ["doc_id", "item_ord"], "left")
    return told.select("doc_id", "item_ord", "start", "end", F.when(F.col("start").isNotNull(), "placed").otherwise(lost).alias("reason"))


def add_items(base: DataFrame, items: DataFrame, docs: DataFrame, codes: DataFrame, candidates: Callable = context_candidates) -> tuple[DataFrame, DataFrame]:
    """(spans to add, item_ord and reason of every item) for re-extracted items (doc_id, item_ord, text, type, before, at,
    assertions): unknown types and, but for laboratory types, short terms go; the others are placed in order, coded by
    ``codes`` and keep the labels of the vocabulary."""
    kind = F.when(~F.col("type").isin(*vocab.TYPES), "unknown type").when(~F.col("type").isin(*LAB_TYPES) & short_term(F.col("text")), "short term")
    judged = keep(items.withColumn("_why", kind))  # read five times below
    placed = place_items(judged.filter("_why is null").select("doc_id", "item_ord", "text", "before", "at"), base, docs, candidates)
    allowed = F.array(*[F.lit(a) for a in vocab.ASSERTIONS])
    found = placed.filter("reason = 'placed'").drop("reason").join(judged.select("doc_id", "item_ord", "text", "type", F.array_intersect("assertions", allowed).alias("assertions")), ["doc_id", "item_ord"])
    # a place found with case or spaces let go holds the document's own text
    own = found.join(docs, "doc_id").withColumn("text", F.expr("substring(body, start + 1, end - start)")).drop("body")
    reasons = judged.filter("_why is not null").select("doc_id", "item_ord", F.col("_why").alias("reason")).unionByName(placed.select("doc_id", "item_ord", "reason"))
    return E.recode(own, codes, F.lit(True)), reasons


# ---- further mentions of known surfaces, whatever their case, spaces and hyphens

# ASCII white space only, as Spark's own patterns have it
PIECES = re.compile(r"[0-9A-Za-zÀ-ỹ]+|[^\s\-–—0-9A-Za-zÀ-ỹ]", re.ASCII)
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))  # odd constants of 64 bits


class PieceKeys:
    """Words and single other marks of texts, and 128-bit keys of any run of them from two prefix sums (Karp and Rabin).

    A key tells the pieces in lower case, and between which of them a gap (spaces, hyphens, dashes) stands; if ``exact``, the pieces
    and gaps as they are."""

    def __init__(self, exact: bool = False) -> None:
        self.exact = exact
        self.seen: dict[str, int] = {}
        self.powers = np.ones((2, 1), dtype=np.uint64)

    def _value(self, piece: str) -> int:
        low = piece if self.exact else piece.lower()
        if low not in self.seen:
            self.seen[low] = int.from_bytes(blake2b(low.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return self.seen[low]

    def cut(self, text: str) -> None:
        """Sets start, end, glued (no gap before), word (letters or digits) and the sums for the pieces of ``text``."""
        found = list(PIECES.finditer(text))
        self.start, self.end = (np.array([f(m) for m in found], dtype=np.int64) for f in (re.Match.start, re.Match.end))
        self.glued = np.append(False, self.start[1:] == self.end[:-1]) if found else np.zeros(0, dtype=bool)
        self.word = np.array([_WORD.match(m[0]) is not None for m in found], dtype=bool)
        own = np.array([self._value(m[0]) for m in found], dtype=np.uint64)
        n = len(found)
        if self.powers.shape[1] <= n:
            self.powers = np.stack([np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(2 * n, x)))) for x in _ODD])
        self.own = own
        if self.exact:
            led = np.array([self._value(text[a : m.end()]) for a, m in zip([0, *self.end.tolist()], found)], dtype=np.uint64)  # with the gap before
        else:
            led = own * np.uint64(2) + self.glued
        # a piece weighs by its place from the text's start; the power of a run's start makes that its place in the run
        inverse = [np.uint64(pow(int(x), -1, 1 << 64)) for x in _ODD]
        back = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, x)))) for x in inverse]
        self.sums = [np.concatenate(([np.uint64(0)], np.cumsum(led * b[:n]))) for b in back]

    def runs(self, size: int) -> np.ndarray:
        """(2, count) keys of the runs of ``size`` pieces, by their first piece."""
        count = max(len(self.own) - size + 1, 0)
        keys = np.empty((2, count), dtype=np.uint64)
        for k, (sums, power) in enumerate(zip(self.sums, self.powers, strict=True)):
            h = self.own[:count] + (sums[size : size + count] - sums[1 : 1 + count]) * power[:count]
            h = (h ^ (h >> np.uint64(32))) * _ODD[1 - k] + np.uint64(size)
            keys[k] = h ^ (h >> np.uint64(29))
        return keys

    def free(self, size: int) -> np.ndarray:
        """Which of these runs have no letter or digit right before or after."""
        count = max(len(self.own) - size + 1, 0)
        before = self.glued & np.append(False, self.word[:-1]) if len(self.own) else self.glued
        after = np.append(self.glued & self.word, False)
        return ~before[:count] & ~after[size : size + count]


_WORD = re.compile(r"[0-9A-Za-zÀ-ỹ]")


def _whole_keys(keys: PieceKeys) -> list[int]:
    return keys.runs(len(keys.own)).view(np.int64)[:, 0].tolist()


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, type) with the keys of their pieces and, where no gap stands at either end, of the text as it is."""
    loose, exact = PieceKeys(), PieceKeys(exact=True)
    for batch in batches:
        rows = []
        for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            loose.cut(text)
            exact.cut(text)
            if size := len(loose.own):
                whole = loose.start[0] == 0 and loose.end[-1] == len(text)
                rows.append((text, kind, size, *_whole_keys(loose), *(_whole_keys(exact) if whole else (None, None))))
        yield pa.RecordBatch.from_pylist([dict(zip(_TERMS.names, r, strict=True)) for r in rows], schema=_TERMS)


_TERMS = pa.schema([("text", pa.string()), ("type", pa.string()), ("size", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64())])


def _run_batches(sizes: list[int], words, exact: bool):
    """Rows (doc_id, body) to the runs of ``sizes`` pieces that the filter of known keys lets pass, told by their keys alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose, whole = PieceKeys(), PieceKeys(exact=True)
        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text, parts = body.as_py(), []
                whole.cut(text)
                if not exact:
                    loose.cut(text)
                keys = whole if exact else loose
                for size in sizes:
                    if size > len(keys.own):
                        break
                    k = keys.runs(size).view(np.int64)
                    at = np.flatnonzero(keys.free(size) & bloom.hits(words.value, k[0]))
                    parts.append((keys.start[at], keys.end[at + size - 1], k[0, at], k[1, at], k[0, at] if exact else whole.runs(size).view(np.int64)[0, at]))
                if parts:
                    start, end, k1, k2, x1 = (np.concatenate(c) for c in zip(*parts, strict=True))
                    columns = [pa.array(np.full(len(start), doc_id, dtype=np.int64)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(k1), pa.array(k2)]
                    yield pa.RecordBatch.from_arrays([*columns, *([] if exact else [pa.array(x1)])], ["doc_id", "start", "end", "k1", "k2", *([] if exact else ["x1"])])

    return run


def _free_mentions(body: str) -> Callable:
    """Base spans come first (``rank`` null), by start, then mentions by rank: the text of those that find their place free."""
    starts: list[int] = []
    ends: list[int] = []

    def ask(s: int, e: int, rank: int | None) -> tuple[str | None]:
        if rank is None:
            if ends and s < ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                starts.append(s)
                ends.append(e)
            return (None,)
        at = bisect_right(starts, s)
        if (at > 0 and ends[at - 1] > s) or (at < len(starts) and starts[at] < e):
            return (None,)
        starts.insert(at, s)
        ends.insert(at, e)
        return (body[s:e],)

    return ask


def repeat_scan(base: DataFrame, docs: DataFrame, stage: int = 1) -> DataFrame:
    """doc_id, start, end, text, type: further mentions of the base's surfaces, the longest first, none overlapping the base
    or each other; the type is the surface's most frequent one (ties: the first in the vocabulary).

    stage 1: word for word, no short terms.  stage 2: spaces, hyphens and case let go, short terms too unless they are
    numbers; word-for-word mentions of longer terms are stage 1's.  A mention has no letter or digit on either side.

    Both sides are cut into words and marks.  The key of a surface's pieces meets the keys of the documents' runs of as many
    pieces in an equi-join; a Bloom filter of the surfaces' keys goes before it.  Surfaces of one key are one row, so a run is a row of
    numbers that meets one; texts are cut from the document of those that are kept, where it comes before its mentions."""
    order = F.array_position(F.array(*[F.lit(t) for t in vocab.TYPES]), F.col("type"))
    kinds = base.groupBy("text", "type").agg(F.count("*").alias("c"))
    terms = kinds.groupBy("text").agg(F.min_by("type", F.struct((-F.col("c")).alias("c"), order.alias("o"))).alias("type")).filter("trim(text) <> ''")
    short = short_term(F.col("text"))
    terms = terms.filter(~short if stage == 1 else ~(short & F.col("text").rlike(r"^[\d.,]+$")))
    told = terms.select("text", "type").mapInArrow(_term_batches, "text string, type string, size int, k1 bigint, k2 bigint, x1 bigint, x2 bigint")
    if stage == 1:
        keyed = keep(told.filter("x1 is not null").select("size", F.col("x1").alias("k1"), F.col("x2").alias("k2"), "type"))
    else:
        # a mention takes the longest surface, then the first, that it is not itself: of the first two of a key one is
        each = F.struct((-F.length("text")).alias("o"), "text", "x1", short.alias("short"), "type")
        keyed = keep(told.groupBy("size", "k1", "k2").agg(F.slice(F.array_sort(F.collect_list(each)), 1, 2).alias("found")))
    sizes = sorted(r["size"] for r in keyed.select("size").distinct().collect())  # n lengths need n * n / 2 pieces of surfaces
    runs = docs.select(F.col("doc_id").cast("long"), "body").mapInArrow(_run_batches(sizes, bloom.words(keyed, "k1"), stage == 1), "doc_id bigint, start int, end int, k1 bigint, k2 bigint" + (", x1 bigint" if stage == 2 else ""))
    hits = runs.join(keyed.drop("size"), ["k1", "k2"])
    if stage == 2:
        other = F.get(F.filter("found", lambda f: f["x1"].isNull() | (f["x1"] != F.col("x1")) | f["short"]), F.lit(0))
        hits = hits.withColumn("type", other["type"]).filter("type is not null")
    rank = (F.col("start") - F.col("end")).alias("_rank")
    taken = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("int").alias("_rank"))
    rows = hits.select("doc_id", "start", "end", "type", rank).unionByName(taken)
    placed = beside(rows, docs, ["start", "end", "_rank"], _free_mentions, {"text": pa.string()}, ("_rank", "start", "end"))
    return placed.filter("text is not null").select("doc_id", "start", "end", "text", "type")


# ---- drafts and checks


def annotation_skeleton(docs: DataFrame, n: int) -> DataFrame:
    """The parsed lines of ``n`` documents at even steps through their lengths, each with an empty slot for concepts."""
    sized = docs.select("doc_id", F.length("text").alias("_size"))
    chosen = docs.join(F.broadcast(systematic_sample(sized, "_size", "doc_id", n).select("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    slot = F.array(F.struct(F.lit("").alias("text"), F.lit("").alias("type"), F.array().cast("array<string>").alias("candidates"), F.array().cast("array<string>").alias("assertions")))
    return parse_lines(chosen).withColumn("concepts", slot)


def annotation_check(given: DataFrame, docs: DataFrame, types: tuple[str, ...] = vocab.TYPES[:3]) -> DataFrame:
    """``given`` (doc_id, text, type, ...) with outcome (ok, type, not found) and start, the first place of the text; rows
    without a text are left out.  A set may be written where all are ok."""
    at = F.instr("body", F.col("text"))
    outcome = F.when(~F.col("type").isin(*types), "type").when(F.coalesce(at, F.lit(0)) == 0, "not found").otherwise("ok")
    told = given.filter("text <> ''").join(docs, "doc_id", "left").withColumn("outcome", outcome)
    return told.withColumn("start", F.when(F.col("outcome") == "ok", at - 1)).drop("body")


def draft_report(hits: DataFrame, codes: DataFrame) -> DataFrame:
    """type, n, uncoded of a draft: hits (doc_id, start, end, term, layer) claim in layers (drug, diagnosis, symptom)."""
    kinds = F.array(*[F.lit(t) for t in vocab.TYPES[:3]])
    drafted = K.layered_claim(hits).withColumn("type", F.get(kinds, F.col("layer")))
    coded = drafted.join(codes.select(F.col("surface").alias("term"), "type", "codes"), ["term", "type"], "left")
    missing = F.col("codes").isNull() & F.col("type").isin(*vocab.CODED_TYPES)
    return coded.groupBy("type").agg(F.count("*").alias("n"), F.count_if(missing).alias("uncoded"))


# ---- reports and batches


def diff_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """added, removed, labels, codes (rows of both that differ there), coded_delta (added or removed rows of coded types), axes
    and verdict, one row: a score can be put down to one axis only where one axis changed."""
    none = F.array().cast("array<string>")

    def side(df: DataFrame, n: str) -> DataFrame:
        codes = F.col("codes") if "codes" in df.columns else none
        return df.select(*E.KEY, F.array_sort("assertions").alias(f"l{n}"), F.array_sort(codes).alias(f"c{n}"), F.lit(True).alias(f"in{n}"))

    both = side(a, "a").join(side(b, "b"), E.KEY, "full_outer")
    added, removed = F.col("ina").isNull(), F.col("inb").isNull()
    counts = both.agg(
        F.count_if(added).alias("added"), F.count_if(removed).alias("removed"), F.count_if(F.col("la") != F.col("lb")).alias("labels"), F.count_if(F.col("ca") != F.col("cb")).alias("codes"),
        F.count_if((added | removed) & F.col("type").isin(*vocab.CODED_TYPES)).alias("coded_delta"),
    )
    axes = sum((F.col(c) > 0).cast("int") for c in ("added", "removed", "labels", "codes"))
    return counts.withColumn("axes", axes).withColumn("verdict", F.when(F.col("axes") > 1, "several axes").when(F.col("axes") == 1, "one axis").otherwise("nothing changed"))


def run_edits(base: DataFrame, jobs: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each job applied to the base, and the reports of all of them beside their names.  Jobs are independent: a job that
    takes another's result is a function of both."""
    made = {name: job(base) for name, job in jobs}
    reports = None
    for name, result in made.items():
        one = diff_report(base, result).withColumn("job", F.lit(name))
        reports = one if reports is None else reports.unionByName(one)
    return made, reports
