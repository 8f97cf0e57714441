"""Edits of an annotation set (doc_id, base_ord, start, end, text, type, assertions[, codes]) by what voters say.

Every edit is joins and windows keyed by doc_id.  Edits that must not change the number of rows return one row for each
row of the base, by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions.text import banned, surface, weak
from spanloom.operators import consensus as C
from spanloom.operators.spans import anti_overlap, best_overlap, greedy, overlap_join
from spanloom.sources.shared import keep

KEY = C.KEY


def recode(spans: DataFrame, codes: DataFrame, changed: Column) -> DataFrame:
    """``spans`` with the codes that ``codes`` (surface, type, codes) has for the rows that ``changed``, none for uncoded
    types and unknown surfaces; other rows keep theirs.  The map may be large, so Spark picks the join."""
    none = F.array().cast("array<string>")
    key = F.when(changed & F.col("type").isin(*vocab.CODED_TYPES), surface(F.col("text")))
    new = codes.select(F.col("surface").alias("_key"), "type", F.col("codes").alias("_codes"))
    keyed = spans.withColumn("_key", key).withColumn("_changed", changed).join(new, ["_key", "type"], "left")
    old = F.col("codes") if "codes" in spans.columns else none
    return keyed.withColumn("codes", F.when(F.col("_changed"), F.coalesce("_codes", none)).otherwise(old)).drop("_key", "_changed", "_codes")


def augment(base: DataFrame, votes: DataFrame, k: int, resolve: bool = False, codes: DataFrame | None = None) -> DataFrame:
    """Spans to add: k voters agree on them, the base has not got them, and they overlap nothing in the base.  With a map
    ``codes`` they get theirs.

    Two additions may overlap each other unless ``resolve`` is set."""
    new = C.consensus(votes, k).join(base.select(*KEY), KEY, "left_anti")
    new = anti_overlap(new, base)
    new = C.resolve_overlaps(new) if resolve else new
    return new if codes is None else recode(new, codes, F.lit(True))


def drop_by_rule(base: DataFrame, rule: Column, covered: DataFrame | None = None, types: tuple[str, ...] | None = None) -> DataFrame:
    """The rows that stay when all mentions of a surface go for which ``rule`` holds; where ``covered`` is given only
    its documents are edited, where ``types`` is given only spans of these types."""
    bad = base.filter(rule if types is None else rule & F.col("type").isin(*types)).select(surface(F.col("text")).alias("_s"), "type").distinct()
    keyed = base.withColumn("_s", surface(F.col("text")))
    if covered is None:
        return keyed.join(bad, ["_s", "type"], "left_anti").drop("_s")
    flagged = keyed.join(bad.withColumn("_bad", F.lit(True)), ["_s", "type"], "left").join(covered.withColumn("_in", F.lit(True)), "doc_id", "left")
    return flagged.filter("not (coalesce(_bad, false) and coalesce(_in, false))").drop("_s", "_bad", "_in")


def prune_spec(base: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    return drop_by_rule(base, banned(F.col("text")).isNotNull(), types=types)


def prune_weak(base: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    return drop_by_rule(base, weak(F.col("text")), types=types)


def uncorroborated(base: DataFrame, votes: DataFrame, min_votes: int, rescue: bool = True, covered: DataFrame | None = None) -> DataFrame:
    """Surfaces (surface, type) of the base that fewer than ``min_votes`` voters have anywhere and, with ``rescue``, no
    mention of which overlaps spans of that many voters.  Only covered documents give evidence; banned and weak surfaces
    are not judged, as voters were told to leave them out."""
    covered = C.covered_docs(votes) if covered is None else covered
    seen = base.join(covered, "doc_id", "left_semi").filter(banned(F.col("text")).isNull() & ~weak(F.col("text")))
    seen = seen.withColumn("surface", surface(F.col("text")))
    all_seen = seen.select("surface", "type").distinct()
    backed = C.surface_support(votes).filter(F.col("n_voters") >= min_votes).select("surface", "type")
    out = all_seen.join(backed, ["surface", "type"], "left_anti")
    if not rescue:
        return out
    right = votes.select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "voter_ord")
    near = overlap_join(seen.join(out, ["surface", "type"], "left_semi").select("doc_id", "base_ord", "start", "end", "surface", "type"), right)
    rescued = near.groupBy("doc_id", "base_ord", "surface", "type").agg(F.bit_count(F.bit_or(C.voter_bit())).alias("n")).filter(F.col("n") >= min_votes).select("surface", "type").distinct()
    return out.join(rescued, ["surface", "type"], "left_anti")


def prune_uncorroborated(base: DataFrame, votes: DataFrame, min_votes: int, rescue: bool = True, types: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of the base that stay.  Base and votes feed four and three branches, so both are cut off as written tables:
    what they are made from is read once."""
    cols = base.columns
    votes = keep(votes.select("doc_id", "start", "end", "type", "text", "voter_ord"))
    covered = keep(C.covered_docs(votes)).withColumn("_in", F.lit(True))
    base = keep(base.withColumn("_s", surface(F.col("text"))).join(covered, "doc_id", "left"))
    bad = uncorroborated(base.filter("_in").drop("_in"), votes, min_votes, rescue, covered.select("doc_id"))
    bad = bad.filter(F.lit(True) if types is None else F.col("type").isin(*types)).withColumnRenamed("surface", "_s").withColumn("_bad", F.lit(True))
    return base.join(bad, ["_s", "type"], "left").filter("not (coalesce(_bad, false) and coalesce(_in, false))").select(*cols)


def fix_spans(base: DataFrame, votes: DataFrame, k: int, both: bool = False, resolve: bool = False, codes: DataFrame | None = None) -> DataFrame:
    """Replace bounds and type by those of the overlapping k-voter span with the largest overlap (ties: first by bounds
    and type) that the base has not got.  Longer ones only with ``both``; of several rows that want one span the first by
    base_ord gets it.  With a map ``codes`` changed rows get the codes of their new text and type.  The number of rows stays,
    unless ``resolve`` drops overlaps."""
    alt = C.consensus(votes, k).join(base.select("doc_id", "start", "end").distinct(), ["doc_id", "start", "end"], "left_anti")
    right = alt.select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("type").alias("r_type"), F.col("text").alias("r_text"))
    best = best_overlap(base.select("doc_id", "base_ord", "start", "end"), right, "base_ord", ["r_start", "r_end", "r_type"])
    if not both:
        best = best.filter("r_end - r_start < end - start")
    first = Window.partitionBy("doc_id", "r_start", "r_end").orderBy("base_ord")
    won = best.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("doc_id", "base_ord", "r_start", "r_end", "r_type", "r_text")
    out = base.join(won, ["doc_id", "base_ord"], "left").withColumn("changed", F.col("r_start").isNotNull())
    for c in ("start", "end", "type", "text"):
        out = out.withColumn(c, F.coalesce(f"r_{c}", c))
    out = out.drop("r_start", "r_end", "r_type", "r_text")
    out = out if codes is None else recode(out, codes, F.col("changed"))
    return greedy(out, [F.col("base_ord")], [c for c in out.columns if c != "doc_id"]) if resolve else out


def tighten(base: DataFrame, proposals: DataFrame, docs: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Apply (doc_id, old, new): ``new`` must be a strictly shorter piece of the span's text (its first occurrence), stand
    at that place in ``docs`` (doc_id, body) where they are given, and no earlier row of the document may have taken the new
    bounds.  With a map ``codes`` changed rows get the codes of their new text.  Adds outcome."""
    p = proposals.groupBy("doc_id", F.col("old").alias("text")).agg(F.min("new").alias("_new"))
    out = base.join(p, ["doc_id", "text"], "left").withColumn("_at", F.instr("text", F.coalesce("_new", F.lit(""))) - 1)
    fits = F.col("_new").isNotNull() & (F.length("_new") > 0) & (F.length("_new") < F.length("text")) & (F.col("_at") >= 0)
    out = out.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("_s", F.col("start") + F.col("_at")).withColumn("_e", F.col("start") + F.col("_at") + F.length("_new"))
    verbatim = F.lit(True)
    if docs is not None:
        out, verbatim = out.join(docs, "doc_id", "left"), F.coalesce(F.expr("substring(body, _s + 1, _e - _s)") == F.col("_new"), F.lit(False))
    out = out.withColumn("_true", F.col("_fits") & verbatim).drop(*([] if docs is None else ["body"]))
    first = Window.partitionBy("doc_id", "_true", "_s", "_e").orderBy("base_ord")
    out = out.withColumn("_won", F.col("_true") & (F.row_number().over(first) == 1))
    outcome = F.when(F.col("_new").isNull(), "no proposal").when(~F.col("_fits"), "not a shorter piece").when(~F.col("_true"), "not verbatim").when(~F.col("_won"), "bounds taken").otherwise("tightened")
    out = out.withColumn("outcome", outcome)
    return out.withColumn("start", F.when(F.col("_won"), F.col("_s")).otherwise(F.col("start"))).withColumn("end", F.when(F.col("_won"), F.col("_e")).otherwise(F.col("end"))).withColumn("text", F.when(F.col("_won"), F.col("_new")).otherwise(F.col("text"))).drop("_new", "_at", "_fits", "_true", "_s", "_e", "_won").transform(
        lambda d: d if codes is None else recode(d, codes, F.col("outcome") == "tightened")
    )


def fix_assertions(base: DataFrame, votes: DataFrame, k: int, mode: str = "full") -> DataFrame:
    """Take the label set that at least k votes on the exact key agree on, in whatever order they name it; ``add`` only where
    it keeps all labels there are, ``none`` never.  New sets are sorted.  Adds changed."""
    if mode not in ("full", "add", "none"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "none":
        return base.withColumn("changed", F.lit(False))
    labels = votes.withColumn("assertions", F.array_sort("assertions")).groupBy(*KEY, "assertions").agg(F.count("*").alias("n"), F.min(F.struct("voter_ord", "item_ord")).alias("first"))
    best = labels.groupBy(*KEY).agg(F.min_by(F.struct("assertions", "n"), F.struct((-F.col("n")).alias("n"), F.col("first"))).alias("b"))
    best = best.filter(F.col("b.n") >= k).select(*KEY, F.col("b.assertions").alias("_new"))
    out = base.join(best, KEY, "left")
    change = F.col("_new").isNotNull() & (F.array_sort("_new") != F.array_sort("assertions"))
    if mode == "add":
        change = change & (F.size(F.array_except("assertions", "_new")) == 0)
    out = out.withColumn("changed", change)
    return out.withColumn("assertions", F.when(F.col("changed"), F.col("_new")).otherwise(F.col("assertions"))).drop("_new")


def fix_types(base: DataFrame, votes: DataFrame, k: int) -> DataFrame:
    """Take another type where all votes with exactly these bounds give it and there are at least k; codes go where the new
    type has none.  Adds changed."""
    t = votes.groupBy("doc_id", "start", "end").agg(F.count("*").alias("_n"), F.min("type").alias("_lo"), F.max("type").alias("_hi"))
    t = t.filter((F.col("_n") >= k) & (F.col("_lo") == F.col("_hi"))).select("doc_id", "start", "end", "_lo")
    out = base.join(t, ["doc_id", "start", "end"], "left").withColumn("changed", F.coalesce(F.col("_lo") != F.col("type"), F.lit(False)))
    out = out.withColumn("type", F.coalesce("_lo", "type")).drop("_lo")
    if "codes" not in base.columns:
        return out
    return out.withColumn("codes", F.when(F.col("changed") & ~F.col("type").isin(*vocab.CODED_TYPES), F.array().cast("array<string>")).otherwise(F.col("codes")))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """KEY, status: added, removed, labels (assertions differ), codes (codes differ) or same, for two sets with distinct
    keys; codes are compared where both have them."""
    codes = "codes" in a.columns and "codes" in b.columns
    x = a.select(*KEY, F.array_sort("assertions").alias("_la"), *([F.array_sort("codes").alias("_ca")] if codes else []), F.lit(True).alias("_a"))
    y = b.select(*KEY, F.array_sort("assertions").alias("_lb"), *([F.array_sort("codes").alias("_cb")] if codes else []), F.lit(True).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_la") != F.col("_lb"), "labels")
    if codes:
        status = status.when(F.col("_ca") != F.col("_cb"), "codes")
    return x.join(y, KEY, "full_outer").select(*KEY, status.otherwise("same").alias("status"))


def patch(base: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Overwrite ``column`` where ``changes`` (keys, column) has a row; keys may be an index, bounds or a text."""
    return base.join(changes.select(*keys, F.col(column).alias("_new")), keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def probe(base: DataFrame, name: str) -> DataFrame:
    """Perturbations that change one thing each, to learn how a scorer behaves.

    empty, first, wrong_type, shift, duplicate, reverse, fake_codes, dotted_codes, no_labels, or constant:<label>."""
    first = Window.partitionBy("doc_id").orderBy("start", "base_ord")
    one = base.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    swap = {vocab.DRUG: vocab.SYMPTOM, vocab.SYMPTOM: vocab.DIAGNOSIS, vocab.DIAGNOSIS: vocab.SYMPTOM}
    none = F.array().cast("array<string>")
    if name == "empty":
        return base.limit(0)
    if name == "first":
        return one
    if name == "wrong_type":
        return one.withColumn("type", F.coalesce(F.create_map(*[F.lit(x) for kv in swap.items() for x in kv])[F.col("type")], F.lit(vocab.SYMPTOM)))
    if name == "shift":
        return one.withColumn("start", F.col("start") + 1).withColumn("end", F.col("end") + 1)
    if name == "duplicate":
        return one.unionByName(one)
    if name == "reverse":
        return base.withColumn("base_ord", F.count("*").over(Window.partitionBy("doc_id")) + 1 - F.row_number().over(first))
    if name == "fake_codes":
        return base.withColumn("codes", F.when(F.col("type") == vocab.SYMPTOM, F.array(F.lit("99999999"))).otherwise(F.col("codes")))
    if name == "dotted_codes":
        from spanloom.functions.text import dot

        return base.withColumn("codes", F.when(F.col("type") == vocab.DIAGNOSIS, F.transform("codes", dot)).otherwise(F.col("codes")))
    if name == "no_labels":
        return base.withColumn("assertions", none)
    if name.startswith("constant:"):
        return base.withColumn("assertions", F.array(F.lit(name.split(":", 1)[1])))
    raise ValueError(f"unknown probe {name}")


def assertion_vote(base: DataFrame, votes: DataFrame, min_agree: int) -> DataFrame:
    """The older vote on labels: each voter's best-overlapping vote of the same document and type speaks, and the label set
    that most voters give replaces the base's where at least ``min_agree`` do (ties: first by voter_ord).  Adds changed."""
    right = votes.select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("type").alias("r_type"), "voter_ord", F.col("item_ord").alias("r_ord"), F.col("assertions").alias("r_labels"))
    size = F.least("end", "r_end") - F.greatest("start", "r_start")
    met = overlap_join(base.select("doc_id", "base_ord", "start", "end", "type"), right).filter("type = r_type")
    own = met.groupBy("doc_id", "base_ord", "voter_ord").agg(F.min_by("r_labels", F.struct((-size).alias("n"), F.col("r_ord"))).alias("_new"))
    labels = own.groupBy("doc_id", "base_ord", "_new").agg(F.count("*").alias("n"), F.min("voter_ord").alias("first"))
    best = labels.groupBy("doc_id", "base_ord").agg(F.min_by(F.struct("_new", "n"), F.struct((-F.col("n")).alias("n"), F.col("first"))).alias("b"))
    best = best.filter(F.col("b.n") >= min_agree).select("doc_id", "base_ord", F.col("b._new").alias("_new"))
    out = base.join(best, ["doc_id", "base_ord"], "left").withColumn("changed", F.coalesce(F.col("_new") != F.col("assertions"), F.lit(False)))
    return out.withColumn("assertions", F.coalesce("_new", "assertions")).drop("_new")


def merge_types(base: DataFrame, added: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """The base with those spans of ``added`` that have one of ``types`` and overlap nothing in it."""
    return base.unionByName(anti_overlap(added.filter(F.col("type").isin(*types)), base).select(*base.columns))
