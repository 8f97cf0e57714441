"""Preference formatting, with DataFrame functions only.

A pair is a chosen and a rejected conversation.  Their longest common prefix of turns is rendered once as the prompt;
what follows on either side is rendered as its completion, with the spans that are trained on: the text and end mark of
the assistant's turns.  One shuffle by pair serves the ordering, the running offsets and the grouping.  A turn is
compared with the turn at the same place of the other side, so work is linear in the turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The chat template.
START, END, TRAINED_ROLE = "<|im_start|>", "<|im_end|>", "assistant"


def escaped(text: Column) -> Column:
    """Neither a text nor a role can imitate a mark: "<" and "|" with n spaces between get one more, so different texts stay
    different; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<( *)\|", "< $1|")


def _side(turns: Column, side: int) -> Column:
    return F.array_sort(F.filter(turns, lambda t: t["side"] == side))


def preference_pairs(turns: DataFrame, pair: Column, side: Column, order: list[str]) -> DataFrame:
    """pair_id, chosen_turns, rejected_turns, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, status.

    ``turns`` has role and text; ``pair`` and ``side`` (0 chosen, 1 rejected) are expressions over it and ``order`` puts a
    side's turns in order (ties by role, then text; nulls first).  Rows whose pair is null belong to no conversation and
    are left out; extra columns, clashing ones too, are not read; repeated rows are turns of their own; an empty table
    gives no pairs.  A conversation is rendered whole, so its length is bounded by what one row may hold (2 GB).  Turns are
    equal where role and text are, nulls as empty.  Masks are the trained spans of a completion
    as start:end, comma-joined, in code points.  status: pair; identical (both completions are empty); extended (one is);
    unpaired (a side is missing: all of the other is its completion)."""
    role = escaped(F.col("role"))
    rows = turns.select(pair.cast("long").alias("pair_id"), side.cast("int").alias("side"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], role.alias("role"), escaped(F.col("text")).alias("text"))
    rows = rows.filter("pair_id is not null and side in (0, 1)").repartition("pair_id")
    head = F.concat(F.lit(START), F.col("role"), F.lit("\n"))
    rows = rows.withColumn("shown", F.concat(head, F.col("text"), F.lit(END + "\n"))).withColumn("head", F.length(head))
    place = Window.partitionBy("pair_id", "side").orderBy(*[f"o{i}" for i in range(len(order))], "role", "text")
    rows = rows.select("pair_id", "side", F.row_number().over(place).alias("ord"), "role", "shown", "head", F.sum(F.length("shown")).over(place.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"))
    both = rows.groupBy("pair_id").agg(F.collect_list(F.struct("side", "ord", "role", "shown", "head", "stop")).alias("t"))
    both = both.select("pair_id", _side(F.col("t"), 0).alias("a"), _side(F.col("t"), 1).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["shown"] == y["shown"]), F.lit(False)))
    count = F.aggregate(
        same,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")),
        lambda s: s["n"],
    )
    both = both.withColumn("n", count).withColumn("base", F.when(F.col("n") > 0, F.element_at("a", F.col("n"))["stop"]).otherwise(F.lit(0).cast("long")))

    def shown(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda t: t["shown"]), "")

    def rest(name: str) -> Column:
        return F.filter(name, lambda t: t["ord"] > F.col("n"))

    def mask(name: str) -> Column:
        spans = F.transform(
            F.filter(rest(name), lambda t: t["role"] == TRAINED_ROLE),
            lambda t: F.concat_ws(":", (t["stop"] - F.length(t["shown"]) + t["head"] - F.col("base")).cast("string"), (t["stop"] - 1 - F.col("base")).cast("string")),
        )
        return F.array_join(spans, ",")

    na, nb, n = F.size("a"), F.size("b"), F.col("n")
    status = F.when((na == 0) | (nb == 0), "unpaired").when((na == n) & (nb == n), "identical").when((na == n) | (nb == n), "extended").otherwise("pair")
    return both.select(
        "pair_id",
        na.cast("long").alias("chosen_turns"),
        nb.cast("long").alias("rejected_turns"),
        n.cast("long").alias("prefix_turns"),
        shown(F.filter("a", lambda t: t["ord"] <= F.col("n"))).alias("prompt"),
        shown(rest("a")).alias("chosen"),
        shown(rest("b")).alias("rejected"),
        mask("a").alias("chosen_mask"),
        mask("b").alias("rejected_mask"),
        status.alias("status"),
    )


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """The pairs of the conversations table, which names none: conv_id 2k is chosen over 2k + 1."""
    return preference_pairs(conversations, F.shiftright("conv_id", 1), F.pmod("conv_id", F.lit(2)), ["turn"])


_ESCAPED = "regexp_replace(coalesce({0}, ''), '<( *)\\|', '< \\1|', 'g')"
ORACLE = f"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, {_ESCAPED.format("role")} AS role,
    '{START}' || {_ESCAPED.format("role")} || chr(10) || {_ESCAPED.format("text")} || '{END}' || chr(10) AS shown,
    length('{START}' || {_ESCAPED.format("role")} || chr(10)) AS head,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_ESCAPED.format("role")}, {_ESCAPED.format("text")}) AS ord
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, side ORDER BY ord) AS stop FROM t),
j AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.ord, b.ord) AS ord, a.ord IS NOT NULL AS ina, b.ord IS NOT NULL AS inb,
    coalesce(a.role = b.role AND a.shown = b.shown, false) AS same, a.stop AS stop
  FROM (SELECT * FROM o WHERE side = 0) a FULL JOIN (SELECT * FROM o WHERE side = 1) b ON a.pair_id = b.pair_id AND a.ord = b.ord),
n AS (SELECT pair_id, CAST(count(*) FILTER (ina) AS BIGINT) AS na, CAST(count(*) FILTER (inb) AS BIGINT) AS nb,
    coalesce(min(ord) FILTER (NOT same), max(ord) + 1) - 1 AS n FROM j GROUP BY pair_id),
p AS (SELECT n.*, coalesce((SELECT max(stop) FROM j WHERE j.pair_id = n.pair_id AND j.ord = n.n), 0) AS base FROM n)
SELECT p.pair_id, na AS chosen_turns, nb AS rejected_turns, p.n AS prefix_turns,
  coalesce(string_agg(shown, '' ORDER BY ord) FILTER (side = 0 AND ord <= p.n), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY ord) FILTER (side = 0 AND ord > p.n), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY ord) FILTER (side = 1 AND ord > p.n), '') AS rejected,
  coalesce(string_agg(CAST(stop - length(shown) + head - base AS BIGINT) || ':' || CAST(stop - 1 - base AS BIGINT), ',' ORDER BY ord) FILTER (side = 0 AND ord > p.n AND role = '{TRAINED_ROLE}'), '') AS chosen_mask,
  coalesce(string_agg(CAST(stop - length(shown) + head - base AS BIGINT) || ':' || CAST(stop - 1 - base AS BIGINT), ',' ORDER BY ord) FILTER (side = 1 AND ord > p.n AND role = '{TRAINED_ROLE}'), '') AS rejected_mask,
  CASE WHEN na = 0 OR nb = 0 THEN 'unpaired' WHEN na = p.n AND nb = p.n THEN 'identical' WHEN na = p.n OR nb = p.n THEN 'extended' ELSE 'pair' END AS status
FROM p JOIN o ON o.pair_id = p.pair_id GROUP BY p.pair_id, na, nb, p.n, base
"""
