"""Gates, codecs, samples and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions.text import banned, escape, lenient_double, nfc, undot, unescape, words
from spanloom.operators.spans import adjacent_overlaps
from spanloom.sources.shared import keep


def violations(spans: DataFrame, docs: DataFrame, known_codes: DataFrame, expected: DataFrame, max_overlaps: int = 3) -> DataFrame:
    """doc_id, ord, rule: one row for each rule that a span or document breaks; empty means the set may be written.

    spans: doc_id, ord, start, end, type, text, assertions, codes; docs: doc_id, body; known_codes: type, code, those of
    diagnoses without dots, or one list of codes as they are; expected: the documents that must be there.  Texts may differ from the document in their
    Unicode form."""
    code = F.explode(F.when(F.size("codes") > 0, F.col("codes")))
    joined = spans.join(docs, "doc_id", "left")
    allowed = F.array(*[F.lit(a) for a in vocab.ASSERTIONS])
    position = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("body"))
    slice_ = F.expr("substring(body, start + 1, end - start)")
    coded = F.col("type").isin(*vocab.CODED_TYPES)
    rules = [
        F.when(~F.col("type").isin(*vocab.TYPES), "unknown type"),
        F.when(F.size(F.array_except("assertions", allowed)) > 0, "unknown assertion"),
        F.when(F.size(F.array_distinct("assertions")) < F.size("assertions"), "repeated assertion"),
        F.when(~F.coalesce(position, F.lit(False)), "position"),
        F.when(~coded & (F.size("codes") > 0), "codes on an uncoded type"),
        F.when((F.col("type") == vocab.DIAGNOSIS) & F.exists("codes", lambda c: (F.length(c) > 3) & ~F.contains(c, F.lit("."))), "undotted code"),
    ]
    own = joined.select("doc_id", "ord", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    other = joined.filter(position & (slice_ != F.col("text"))).select("doc_id", "ord", "text", slice_.alias("slice"))
    own = own.unionByName(other.filter(nfc(F.col("slice")) != nfc(F.col("text"))).select("doc_id", "ord", F.lit("text").alias("rule")))
    asked = spans.filter(coded).select("doc_id", "ord", "type", code.alias("code"))
    on = ["code"]
    if "type" in known_codes.columns:
        on = ["type", "code"]
        asked = asked.withColumn("code", F.when(F.col("type") == vocab.DIAGNOSIS, undot(F.col("code"))).otherwise(F.col("code")))
    unknown = asked.join(known_codes.select(*on).distinct(), on, "left_anti").select("doc_id", "ord", F.lit("unknown code").alias("rule")).distinct()
    none = F.lit(None).cast(spans.schema["ord"].dataType).alias("ord")
    crowded = adjacent_overlaps(spans).filter(F.col("n") > max_overlaps).select("doc_id", none, F.lit("overlaps").alias("rule"))
    present = spans.select("doc_id").distinct()
    missing = expected.join(present, "doc_id", "left_anti").select("doc_id", none, F.lit("missing document").alias("rule"))
    extra = present.join(expected, "doc_id", "left_anti").select("doc_id", none, F.lit("unexpected document").alias("rule"))
    return own.unionByName(unknown).unionByName(crowded).unionByName(missing).unionByName(extra)


def encode_lines(spans: DataFrame) -> DataFrame:
    """doc_id, code_text: a line for each span (start, end, type, text, assertions, before) in order: letters of type and
    labels, text, the six characters before it, with | between."""
    types = F.create_map(*[F.lit(x) for kv in vocab.TYPE_LETTER.items() for x in kv])
    labels = F.create_map(*[F.lit(x) for kv in vocab.ASSERTION_LETTER.items() for x in kv])
    tags = F.array_join(F.transform(F.array_sort("assertions"), lambda a: F.coalesce(labels[a], F.lit(""))), "")
    line = F.concat(types[F.col("type")], tags, F.lit("|"), escape(F.col("text")), F.lit("|"), escape(F.expr("right(before, 6)")))
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", line.alias("line"))))
    return spans.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("code_text"))


def decode_lines(coded: DataFrame) -> DataFrame:
    """doc_id, item_ord, text, type, assertions, before; broken lines are left out."""
    types = F.create_map(*[F.lit(x) for k, v in vocab.TYPE_LETTER.items() for x in (v, k)])
    labels = F.create_map(*[F.lit(x) for k, v in vocab.ASSERTION_LETTER.items() for x in (v, k)])
    each = coded.select("doc_id", F.posexplode(F.split("code_text", "\n")).alias("item_ord", "line")).withColumn("p", F.split("line", r"\|"))
    tag = F.trim(F.col("p")[0])
    letters = F.filter(F.split(F.expr("substring(trim(p[0]), 2)"), ""), lambda c: c != "")
    flags = F.array_sort(F.array_distinct(F.array_compact(F.transform(letters, lambda c: labels[c]))))
    out = each.filter(F.size("p") >= 2).select(
        "doc_id", "item_ord", unescape(F.col("p")[1]).alias("text"), types[F.substring(tag, 1, 1)].alias("type"), flags.alias("assertions"), unescape(F.coalesce(F.get("p", F.lit(2)), F.lit(""))).alias("before")
    )
    return out.filter("type is not null and text <> ''")


def train_messages(turns: DataFrame) -> DataFrame:
    """conv_id, messages: the turns of a conversation in order as JSON."""
    item = F.struct("turn", "role", F.col("text").alias("content"))
    sorted_ = F.array_sort(F.collect_list(item))
    return turns.groupBy("conv_id").agg(F.to_json(F.transform(sorted_, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("messages"))


def modulus_split(df: DataFrame, key: str, n: int = 7) -> DataFrame:
    """Adds split: dev for the ids 1, n + 1, 2n + 1 and so on, else train."""
    return df.withColumn("split", F.when(F.pmod(F.col(key) - 1, F.lit(n)) == 0, "dev").otherwise("train"))


def range_ranks(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` numbered from 0 in ``order``, and _total.  Ranges are numbered by themselves and moved by the sizes of those
    before them, so no task holds all rows.

    Borders of ranges are drawn from a sample, and a plan that reads them twice may draw them twice or join them otherwise;
    so the numbered ranges are written, and sizes and rows are read from what was written."""
    spread = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    ranked = keep(spread.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order))))
    counts = ranked.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_p", before.alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"))
    return ranked.join(F.broadcast(counts), "_p").withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_p", "_r", "_before")


def systematic_sample(df: DataFrame, size: str, key: str, n: int) -> DataFrame:
    """n rows at even steps through the rows sorted by (size, key), the floor of every whole multiple of total / n."""
    placed = range_ranks(df, [size, key], "_rank")
    # in whole numbers: the first multiple at or after a rank, which falls onto it or not
    placed = placed.withColumn("_k", F.expr(f"(_rank * {n} + _total - 1) div _total"))
    return placed.filter(f"_k < {n} and (_k * _total) div {n} = _rank").drop("_total", "_rank", "_k")


def density_gate(votes: DataFrame, least_median: int = 8) -> DataFrame:
    """doc_id, voter, n, median: voters with less than half of the upper median of a document's counts, where that is at
    least ``least_median``."""
    n = votes.groupBy("doc_id", "voter").agg(F.count("*").alias("n"))
    med = n.groupBy("doc_id").agg(F.array_sort(F.collect_list("n")).alias("a")).select("doc_id", F.get("a", F.floor(F.size("a") / 2).cast("int")).alias("median"))
    return n.join(med, "doc_id").filter((F.col("median") >= least_median) & (F.col("n") * 2 < F.col("median")))


def missing_docs(votes: DataFrame, expected: DataFrame) -> DataFrame:
    """voter, doc_id pairs that are absent."""
    voters = votes.select("voter").distinct()
    grid = expected.join(F.broadcast(voters))
    return grid.join(votes.select("voter", "doc_id").distinct(), ["voter", "doc_id"], "left_anti")


# ---- ledgers


def score(wer: Column, labels: Column, codes: Column) -> Column:
    """The final score in per cent from axes in per cent."""
    return 0.3 * (100 - wer) + 0.3 * labels + 0.4 * codes


def ledger_numbers(raw: DataFrame) -> DataFrame:
    """run, score, wer, j_assert, j_cand as doubles, and mismatch: the recorded score differs from the formula."""
    nums = raw.select("stt", "run", *[lenient_double(F.col(c)).alias(c) for c in ("score", "wer", "j_assert", "j_cand")])
    return nums.withColumn("mismatch", F.abs(score(F.col("wer"), F.col("j_assert"), F.col("j_cand")) - F.col("score")) > 0.01)


def ledger_deltas(ledger: DataFrame, base_run: str) -> DataFrame:
    """Each scored run against the base: delta and the part of each axis, in points."""
    scored = ledger.filter("score is not null and wer is not null and j_assert is not null and j_cand is not null")
    own = F.col("run") == base_run  # the first of that name: one row whatever the ledger holds
    base = scored.agg(*[F.min_by(F.when(own, F.col(c)), F.when(own, F.col("stt"))).alias(n) for c, n in (("score", "b"), ("wer", "bw"), ("j_assert", "ba"), ("j_cand", "bc"))])
    return scored.join(F.broadcast(base)).select(
        "stt", "run", "score", (F.col("score") - F.col("b")).alias("delta"), (-(F.col("wer") - F.col("bw")) * 0.3).alias("by_wer"), ((F.col("j_assert") - F.col("ba")) * 0.3).alias("by_assert"), ((F.col("j_cand") - F.col("bc")) * 0.4).alias("by_cand")
    )


def ledger_best(ledger: DataFrame) -> DataFrame:
    """Each scored run with the best score before it and whether it beats that.  A ledger is one history, in one window."""
    w = Window.partitionBy(F.lit(1)).orderBy("stt").rowsBetween(Window.unboundedPreceding, -1)
    return ledger.filter("score is not null").withColumn("best_before", F.max("score").over(w)).withColumn("is_best", F.coalesce(F.col("score") > F.col("best_before"), F.lit(True)))


def dose_verdict(deltas: DataFrame, pairs: DataFrame) -> DataFrame:
    """light, heavy, verdict for pairs of runs of the same lever."""
    a = deltas.select(F.col("run").alias("light"), F.col("delta").alias("dl"))
    b = deltas.select(F.col("run").alias("heavy"), F.col("delta").alias("dh"))
    verdict = F.when((F.col("dh") > F.col("dl")) & (F.col("dl") > 0), "raise").when((F.col("dl") > 0) & (F.col("dh") <= 0), "between").when(F.col("dl") > F.col("dh"), "lower").otherwise("drop")
    return pairs.join(a, "light").join(b, "heavy").select("light", "heavy", "dl", "dh", verdict.alias("verdict"))


def additivity(deltas: DataFrame, parts: list[str], whole: str) -> DataFrame:
    """Sum of single deltas against the combined run: additive at 80 per cent of the sum or more."""
    return deltas.agg(F.sum(F.when(F.col("run").isin(*parts), F.col("delta"))).alias("parts_sum"), F.max(F.when(F.col("run") == whole, F.col("delta"))).alias("whole")).withColumn("additive", F.col("whole") >= 0.8 * F.col("parts_sum"))


# ---- what a build takes from its voters


def short_term(text: Column) -> Column:
    """One word of fewer than five characters."""
    return (F.size(words(text)) < 2) & (F.length(text) < 5)


def numeric_only(text: Column) -> Column:
    return text.rlike(r"^[\d.,]+$")


def clean_votes(votes: DataFrame, ban: bool = True) -> DataFrame:
    """``votes`` with reason and with types trimmed and assertions of the vocabulary only, each once, sorted.

    reason: accepted, broken item (no text), unknown type, or banned and why; what is not accepted is for counting."""
    allowed = F.array(*[F.lit(a) for a in vocab.ASSERTIONS])
    kind = F.trim(F.coalesce("type", F.lit("")))
    why = F.when(F.col("text").isNull(), "broken item").when(~kind.isin(*vocab.TYPES), "unknown type")
    if ban:
        why = F.coalesce(why, F.concat(F.lit("banned: "), banned(F.col("text"))))
    none = F.array().cast("array<string>")
    return votes.select(
        *[F.col(c) for c in votes.columns if c not in ("type", "assertions")], kind.alias("type"), F.array_sort(F.array_distinct(F.array_intersect(F.coalesce("assertions", none), allowed))).alias("assertions"),
        F.coalesce(why, F.lit("accepted")).alias("reason"),
    )


def most_common(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n most frequent keys with their counts; ties by key.  A top-k: each task keeps n rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(n)
