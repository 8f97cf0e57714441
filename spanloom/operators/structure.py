"""Lines, sections and label context of semi-structured documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.operators.spans import anti_overlap

# Line shapes.
SECTION = r"(?U)^\s*(\d)\.\s+(.{3,60}?)\s*$"
LABELLED = r"(?U)^\s*([^:\-–•*][^:]{2,55}):\s*(.*)$"
BULLET = r"(?U)^\s*[-–•*]\s*(.*)$"
BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85  "


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no, start, line: lines without their ends, with their offsets.

    All the line ends that Python's splitlines knows cut; each is one character, so offsets are running sums of lengths.
    A carriage return before a line feed stays with its line and is trimmed later."""
    one = F.translate(F.col(text), BREAKS, "\n" * len(BREAKS))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    start = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return docs.select("doc_id", F.posexplode(F.split(one, "\n")).alias("line_no", "line")).withColumn("start", start)


SLICE = 64  # documents whose tokens are in memory at once


def cut_tokens(docs: DataFrame, ahead: int = 0, where: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """doc_id, ord, start, w, and w1 to w``ahead``, the next tokens of the document: what stands between the blanks of
    (doc_id, body), the pieces of ``where`` (doc_id, start and length to a mask) only.

    Offsets are running sums over the columns of an Arrow batch, so no document's tokens are shuffled to be placed."""
    names = ["doc_id", "ord", "start", "w", *[f"w{k}" for k in range(1, ahead + 1)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lists = pc.split_pattern(part.column(1), " ")
                n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                words, row = lists.flatten(), np.repeat(np.arange(len(n)), n)
                first = (np.cumsum(n) - n)[row]
                size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(size + 1)
                opens = ends - size - 1
                start, place = opens - opens[first], np.arange(len(row))
                doc_id = part.column(0).to_numpy(zero_copy_only=False)[row]
                took = place if where is None else np.flatnonzero(where(doc_id, start, size))
                last = (first + n[row] - 1)[took]
                columns = [part.column(0).take(pa.array(row[took])), pa.array((place - first)[took], pa.int32()), pa.array(start[took], pa.int32())]
                for k in range(ahead + 1):
                    columns.append(words.take(pa.array(took + k, pa.int64(), mask=took + k > last)))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "body").mapInArrow(run, "doc_id bigint, ord int, start int, " + ", ".join(f"{w} string" for w in names[3:]))


def is_bare_subheader(line: Column) -> Column:
    t = F.lower(F.trim(line))
    prefixes = F.array(*[F.lit(p) for p in vocab.SUBHEADER_PREFIXES])
    return (F.length(t) <= 60) & ~t.rlike(r"(?U)\d") & F.exists(prefixes, lambda p: F.startswith(t, p))


def _rtrim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def parse_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no, start, end, text, section, sub, kind, historical, skip: the lines that carry content.

    A section line sets the section and clears the label; "label: value" sets the label and is a row where the value is
    not blank; a bare label line sets it; bullets and plain lines are rows.  First match in that order: section, bullet,
    label, bare label, plain."""
    lines = split_lines(docs, text).filter(F.col("line").rlike(r"(?U)\S"))
    line = F.col("line")
    kind = F.when(line.rlike(SECTION), "section").when(line.rlike(BULLET), "bullet").when(line.rlike(LABELLED), "value").when(is_bare_subheader(line), "label").otherwise("plain")
    body = F.when(F.col("kind") == "bullet", F.regexp_extract(line, BULLET, 1)).when(F.col("kind") == "value", F.regexp_extract(line, LABELLED, 2)).otherwise(F.regexp_replace(line, r"(?U)^\s+", ""))
    lines = lines.withColumn("kind", kind).withColumn("_body", body)
    lines = lines.withColumn("_sec", F.when(F.col("kind") == "section", F.lower(F.trim(F.regexp_extract(line, SECTION, 2)))))
    label = F.when(F.col("kind") == "value", F.lower(F.trim(F.regexp_extract(line, LABELLED, 1)))).when(F.col("kind") == "label", F.lower(F.trim(line))).when(F.col("kind") == "section", "")
    lines = lines.withColumn("_label", label)
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.coalesce(F.last("_sec", True).over(w), F.lit(""))).withColumn("sub", F.coalesce(F.last("_label", True).over(w), F.lit("")))
    begin = F.col("start") + F.length("line") - F.length("_body")
    out = lines.filter(F.col("kind").isin("bullet", "value", "plain")).withColumn("_text", _rtrim(F.col("_body"))).filter("_text <> ''")
    return out.select(
        "doc_id", "line_no", begin.alias("start"), (begin + F.length("_text")).alias("end"), F.col("_text").alias("text"), "section", "sub", "kind",
        (F.col("section").isin(*vocab.HISTORY_SECTIONS) | F.col("sub").isin(*vocab.HISTORICAL_SUBS)).alias("historical"), F.col("sub").isin(*vocab.SKIPPED_SUBS).alias("skip"),
    )


def short_lines(lines: DataFrame, spans: DataFrame, max_words: int = 6) -> DataFrame:
    """Lines of up to ``max_words`` words that overlap no span."""
    n = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    return anti_overlap(lines.filter(n <= max_words), spans)


def forward_fill(rows: DataFrame, by: str, order: str, flag: Column, value: Column, name: str) -> DataFrame:
    """``rows`` with the value of the last row up to and with each one for which ``flag`` holds."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(flag, value), True).over(w))


def section_at(spans: DataFrame, headers: DataFrame, priority: Column) -> DataFrame:
    """As-of join: each span with the label of the nearest header (doc_id, pos, label) that starts before it; among
    headers at one place the lowest ``priority``.  One sorted pass over both sides instead of a range join."""
    row = F.struct(*[F.col(c) for c in spans.columns])
    best = headers.groupBy("doc_id", "pos").agg(F.min_by("label", priority).alias("label"))
    a = spans.select("doc_id", F.col("start").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("string").alias("_label"), row.alias("_row"))
    b = best.select("doc_id", F.col("pos").alias("_at"), F.lit(1).alias("_side"), F.col("label").alias("_label"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy("doc_id").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_last", F.last("_label", True).over(w)).filter("_side = 0").select("_row.*", F.col("_last").alias("section"))


def mask_runs(docs: DataFrame, text: str = "text", width: int = 20) -> DataFrame:
    """doc_id, start, end, mask_len, left, right of every run of three or more asterisks.

    Cut at asterisk runs the pieces and the runs alternate, so their lengths give the offsets."""
    pieces = F.split(F.col(text), r"\*{3,}")
    runs = F.regexp_extract_all(F.col(text), F.lit(r"\*{3,}"), F.lit(0))
    each = docs.filter(F.col(text).contains("***")).select("doc_id", F.col(text).alias("_x"), F.posexplode(runs).alias("n", "run"), pieces.alias("_p"))
    w = Window.partitionBy("doc_id").orderBy("n")
    each = each.withColumn("_len", F.length("run")).withColumn("_gap", F.length(F.get("_p", F.col("n"))))
    end = F.sum(F.col("_gap") + F.col("_len")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("_len"))
    return each.select(
        "doc_id", "start", "end", F.col("_len").alias("mask_len"), F.expr(f"substring(_x, cast(greatest(start - {width}, 0) + 1 as int), cast(least({width}, start) as int))").alias("left"),
        F.expr(f"substring(_x, cast(end + 1 as int), {width})").alias("right"),
    )
