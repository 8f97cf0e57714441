"""Audit of how five quality filters interact, by inclusion-exclusion over joint failures.

1. One pass over the texts turns every document into five 0/1 flags (1: it fails that filter).
2. For each part (source) and each of the 32 subsets S of the filters, ``N(S)`` is the sum of the product of the flags in
   S: how many documents fail all of S together, whatever else they fail.  The same is summed over good and toxic rows.
3. Everything asked for follows from these 96 sums by Moebius inversion, whatever the order of the filters:

   * survivors of a set of filters T: sum over S in T of (-1)^|S| N(S); ``kept``, ``removed`` and the losses of a step are
     its values before and after the step;
   * ``redundant``: N({f}) less what the step removes;
   * ``unique_fails``: sum over S of the other filters of (-1)^|S| N(S + f);
   * ``shapley``: the game v(T) = documents failing any of T has the Harsanyi dividends (-1)^(|S|+1) N(S); a filter's
     share is the sum of its dividends over |S|, times 120 here, so that it is the sum over all orders, an integer.

Rows are summed within tasks before they are shuffled, so a source of any size costs a row a task; texts are never shuffled.
Equal texts are found by their SHA-256, salted, so that a text that a third of all rows hold is met in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tables import keep, map_arrow, text_or_empty

FILTERS = "ABCDE"
MIN_WORDS = 200
SALTS = 64
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = b"#$%&*|"
_CONTINUATION = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no code point
_SUBSETS = range(1 << len(FILTERS))
_COUNTS = ("n", "good", "toxic")


def text_failures(raw: bytes) -> tuple[bool, bool, bool, bool]:
    """Conditions A to D, of the text alone: few words, few distinct words, many capitals, a symbol.

    ``bytes.split`` cuts at the six ASCII white-space characters and no others."""
    words = raw.split()
    continued = len(raw) - len(raw.translate(None, _CONTINUATION)) if not raw.isascii() else 0
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < 50 * len(words),
        100 * capitals > 2 * (len(raw) - continued),
        len(raw.translate(None, _SYMBOLS)) < len(raw),
    )


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "doc_id", *FILTERS[:4].lower(), "digest"]
    for batch in batches:
        raw = [x.as_buffer().to_pybytes() for x in batch.column(2)]
        fails = np.array([text_failures(x) for x in raw], dtype=np.int32).reshape(len(raw), 4)
        digests = pa.array([sha256(x).digest() for x in raw], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(fails[:, i]) for i in range(4)), digests], names)


def _flagged(docs: DataFrame) -> DataFrame:
    """part, doc_id, the flags a to e, and whether a smaller doc_id has the same text, for every row of ``docs``."""
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    flags = map_arrow(rows, _text_batches, "part string, doc_id long, a int, b int, c int, d int, digest binary")
    thin = keep(flags.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")))
    salted = thin.groupBy("digest", "salt").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    same = salted.groupBy("digest").agg(F.min("least").alias("least"), F.sum("rows").alias("rows"), F.collect_list("salt").alias("salts")).filter("rows > 1")
    told = thin.join(same.select("digest", "least", F.explode("salts").alias("salt")), ["digest", "salt"], "left")
    return told.select("part", "doc_id", "a", "b", "c", "d", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int").alias("e"))


def joint_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, and n, good, toxic: arrays of 32, the documents that fail all filters of a subset (bit i: filter i) together.

    A doc_id that ``labels`` has more than once is good or toxic if any of its labels says so."""
    marks = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = _flagged(docs).join(marks, "doc_id", "left").select("part", *FILTERS.lower(), F.lit(1).alias("n"), *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in _COUNTS[1:]])
    # documents with equal flags weigh as one row, in the task that has them
    weighed = rows.groupBy("part", *FILTERS.lower()).agg(*[F.sum(m).alias(m) for m in _COUNTS])

    def product(subset: int, weight: str) -> str:
        return " * ".join([*(f for i, f in enumerate(FILTERS.lower()) if subset >> i & 1), weight])

    joint = weighed.groupBy("part").agg(*[F.expr(f"sum({product(s, m)}) {m}{s}") for m in _COUNTS for s in _SUBSETS])
    return joint.selectExpr("part", *[f"array({', '.join(f'{m}{s}' for s in _SUBSETS)}) {m}" for m in _COUNTS])


def _signed(joint: str, subsets: list[int], factors: list[int]) -> str:
    return " + ".join(f"({x}) * {joint}[{s}]" for s, x in zip(subsets, factors, strict=True))


def _survivors(joint: str) -> Column:
    """For each set of filters the rows that fail none of it: the Moebius inversion of the joint failures."""
    below = [[s for s in _SUBSETS if s & t == s] for t in _SUBSETS]
    return F.expr(f"array({', '.join(_signed(joint, inner, [(-1) ** s.bit_count() for s in inner]) for inner in below)})")


_WITH = [[s for s in _SUBSETS if s >> i & 1] for i in range(len(FILTERS))]


def _unique(joint: str) -> Column:
    """For each filter the rows that fail it and no other."""
    return F.expr(f"array({', '.join(_signed(joint, s, [(-1) ** (x.bit_count() - 1) for x in s]) for s in _WITH)})")


def _shapley(joint: str) -> Column:
    """For each filter 120 times its Shapley value: each dividend is shared equally by its filters."""
    return F.expr(f"array({', '.join(_signed(joint, s, [(-1) ** (x.bit_count() - 1) * (120 // x.bit_count()) for x in s]) for s in _WITH)})")


def _steps() -> Column:
    """The 600 steps of all orders: order, step, the index of its filter, the sets of filters before and after it."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            i = FILTERS.index(letter)
            out.append(f"named_struct('filter_order', '{''.join(order)}', 'step', {step}, 'i', {i}, 'before', {before}, 'after', {before | 1 << i})")
            before |= 1 << i
    return F.expr(f"array({', '.join(out)})")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; ``docs`` needs doc_id, text and source, ``labels`` doc_id, quality, toxic.

    Columns: part, filter_order, step, and the document counts kept, removed, redundant, unique_fails, good_lost, toxic_lost
    and shapley.  A null source is the part '', together with an empty one.  A null text is empty: it fails A alone of the first
    four (no word of none is repeated, and 0 is not above 0).  Equal texts: the rows of the smallest doc_id pass E, all of
    them if that doc_id is repeated; a row without a doc_id passes E, has no label and makes no other row fail.  Repeated rows count each.
    Very long texts are read whole; an empty table has no parts and gives no rows; other columns, whatever their names,
    are not read."""
    joint = joint_failures(docs, labels)
    alive = joint.select("part", F.col("n").alias("joint"), *[_survivors(m).alias(m) for m in _COUNTS], _unique("n").alias("unique"), _shapley("n").alias("shares"))
    rows = alive.withColumn("s", F.explode(_steps()))
    s = F.col("s")

    def lost(m: str) -> Column:
        return F.col(m)[s["before"]] - F.col(m)[s["after"]]

    return rows.select(
        "part",
        s["filter_order"].alias("filter_order"),
        s["step"].alias("step"),
        F.col("n")[s["after"]].alias("kept"),
        lost("n").alias("removed"),
        (F.col("joint")[F.expr("cast(shiftleft(1, s.i) as int)")] - lost("n")).alias("redundant"),
        F.col("unique")[s["i"]].alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.col("shares")[s["i"]].alias("shapley"),
    )


#: Each order is walked for each pattern of failures: a document goes at the first filter that it fails.
ORACLE = r"""
WITH RECURSIVE first AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY 1),
w AS (SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS t, list_filter(string_split_regex(coalesce(d.text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents d),
f AS (SELECT w.doc_id, part,
  CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 2 * length(w.t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS fails FROM w JOIN first ON first.t = w.t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
p AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, CAST(step AS INT), 1) AS letter, substr(filter_order, 1, CAST(step - 1 AS INT)) AS earlier FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
g AS (SELECT p.*, s.*, fails <> '' AND contains(fails, letter) AS bad, len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND earlier <> '' AND fails <> '' AS gone FROM p, s),
r AS (SELECT part, filter_order, step, any_value(letter) AS letter,
  sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND bad THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND bad THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND bad THEN toxic ELSE 0 END) AS toxic_lost
  FROM g GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""
