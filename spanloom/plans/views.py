"""Derived views over the driver's tables, for Spark and as DuckDB CTEs.

Spans, votes and codes are made from ``documents`` by arithmetic that both engines evaluate alike, so that every operator
meets agreement, boundary conflicts, label conflicts and type conflicts at known rates.  Tokens are cut where documents are
read and do not shuffle; ``mentions`` shuffles once, by doc_id, and everything keyed by doc_id after it stays where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.operators import consensus as C
from spanloom.operators.structure import cut_tokens
from spanloom.sources.tables import table

VOTERS = ("a", "b", "c", "d")


def docs(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, body: the text with line breaks as spaces, so offsets stay."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("body"))


def tokens(spark: SparkSession, d: str, ahead: int = 0) -> DataFrame:
    """doc_id, ord, start, w and as many of the next tokens as asked."""
    return cut_tokens(docs(spark, d), ahead)


def _pick(values: tuple[str, ...], i: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


def _labels(n: Column) -> Column:
    none = F.array().cast("array<string>")
    return (
        F.when(n == 0, F.array(F.lit("isNegated"))).when(n == 1, F.array(F.lit("isHistorical"))).when(n == 2, F.array(F.lit("isFamily")))
        .when(n == 3, F.array(F.lit("isHistorical"), F.lit("isNegated"))).otherwise(none)
    )


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, start, end, text, type, assertions, item_ord, and what a one-token widening would give (text2, end2)."""
    t = cut_tokens(docs(spark, d), ahead=2, where=lambda doc_id, start, length: (length >= 5) & ((doc_id * 7 + start) % 5 == 0))
    wide = (F.col("start") % 3 == 0) & (F.coalesce(F.length("w1"), F.lit(0)) > 0)
    text = F.when(wide, F.concat_ws(" ", "w", "w1")).otherwise(F.col("w"))
    nxt = F.when(wide, F.col("w2")).otherwise(F.col("w1"))
    t = t.select("doc_id", "start", text.alias("text"), nxt.alias("nxt"))
    t = t.withColumn("end", F.col("start") + F.length("text")).withColumn("text2", F.when(F.length("nxt") > 0, F.concat_ws(" ", "text", "nxt")).otherwise(F.col("text")))
    order = Window.partitionBy("doc_id").orderBy("start")
    return t.select(
        "doc_id", "start", "end", "text", _pick(vocab.TYPES, F.length("text") % 5).alias("type"), _labels(F.col("start") % 13).alias("assertions"),
        F.row_number().over(order).alias("item_ord"), "text2", (F.col("start") + F.length("text2")).alias("end2"),
    )


def votes(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, voter, voter_ord, item_ord, start, end, text, type, assertions."""
    m = mentions(spark, d).withColumn("voter_ord", F.explode(F.sequence(F.lit(0), F.lit(3))))
    m = m.filter("(doc_id * 31 + start * 7 + voter_ord * 13) % 10 < 7")
    wider = (F.col("start") + F.col("voter_ord")) % 11 == 0
    other = (F.col("start") + F.col("voter_ord")) % 9 == 0
    moved = F.when((F.col("start") + F.col("voter_ord")) % 17 == 0, 1).otherwise(0)
    none = F.array().cast("array<string>")
    return m.select(
        "doc_id", _pick(VOTERS, F.col("voter_ord")).alias("voter"), "voter_ord", "item_ord", "start", F.when(wider, F.col("end2")).otherwise(F.col("end")).alias("end"),
        F.when(wider, F.col("text2")).otherwise(F.col("text")).alias("text"), _pick(vocab.TYPES, (F.length("text") + moved) % 5).alias("type"),
        F.when(other, F.when(F.size("assertions") == 0, F.array(F.lit("isHistorical"))).otherwise(none)).otherwise(F.col("assertions")).alias("assertions"),
    )


def coded_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of coded types with codes that vary with the document, so that a surface has several code lists."""
    code = F.when(F.col("type") == vocab.DRUG, (100000 + F.length("text") * 37 + F.col("doc_id") % 3).cast("string")).otherwise(
        F.concat(F.lit("K"), (100 + (F.length("text") * 7 + F.col("doc_id") % 2 + F.col("start") % 3) % 800).cast("string"))
    )
    return mentions(spark, d).filter(F.col("type").isin(*vocab.CODED_TYPES)).withColumn("codes", F.array(code))


def code_map(spark: SparkSession, d: str) -> DataFrame:
    return C.code_map(coded_mentions(spark, d))


def base(spark: SparkSession, d: str) -> DataFrame:
    """Voter a's spans: doc_id, base_ord, start, end, text, type, assertions."""
    return votes(spark, d).filter("voter = 'a'").select("doc_id", F.col("item_ord").alias("base_ord"), "start", "end", "text", "type", "assertions")


def others(spark: SparkSession, d: str) -> DataFrame:
    return votes(spark, d).filter("voter <> 'a'")


def flat(df: DataFrame) -> DataFrame:
    """Lists as strings, integers as longs, for comparing engines."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "array<string>":
            out.append(F.array_join(f.name, "|").alias(f.name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(f.name).cast("long").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


_T = "[" + ", ".join(f"'{t}'" for t in vocab.TYPES) + "]"
_CODED = ", ".join(f"'{t}'" for t in vocab.CODED_TYPES)

#: CTEs in order of dependence; lists are strings joined by "|".
SQL = {
    "docs": "SELECT doc_id, replace(text, chr(10), ' ') AS body FROM documents WHERE text IS NOT NULL",
    "tok0": "SELECT doc_id, unnest(string_split(body, ' ')) AS w, generate_subscripts(string_split(body, ' '), 1) - 1 AS ord FROM docs",
    "tok": """SELECT doc_id, ord, w, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s,
      lead(w) OVER (PARTITION BY doc_id ORDER BY ord) AS w1, lead(w, 2) OVER (PARTITION BY doc_id ORDER BY ord) AS w2 FROM tok0""",
    "men0": """SELECT doc_id, s, CASE WHEN s % 3 = 0 AND coalesce(length(w1), 0) > 0 THEN w || ' ' || w1 ELSE w END AS text,
      CASE WHEN s % 3 = 0 AND coalesce(length(w1), 0) > 0 THEN w2 ELSE w1 END AS nxt FROM tok WHERE length(w) >= 5 AND (doc_id * 7 + s) % 5 = 0""",
    "mention": f"""SELECT doc_id, s, s + length(text) AS e, text, ({_T})[length(text) % 5 + 1] AS type,
      CASE s % 13 WHEN 0 THEN 'isNegated' WHEN 1 THEN 'isHistorical' WHEN 2 THEN 'isFamily' WHEN 3 THEN 'isHistorical|isNegated' ELSE '' END AS asr,
      row_number() OVER (PARTITION BY doc_id ORDER BY s) AS item_ord,
      CASE WHEN length(nxt) > 0 THEN text || ' ' || nxt ELSE text END AS text2,
      s + length(CASE WHEN length(nxt) > 0 THEN text || ' ' || nxt ELSE text END) AS e2 FROM men0""",
    "votes": f"""SELECT doc_id, (['a', 'b', 'c', 'd'])[v + 1] AS voter, v AS voter_ord, item_ord, s, CASE WHEN (s + v) % 11 = 0 THEN e2 ELSE e END AS e,
      CASE WHEN (s + v) % 11 = 0 THEN text2 ELSE text END AS text, ({_T})[(length(text) + CASE WHEN (s + v) % 17 = 0 THEN 1 ELSE 0 END) % 5 + 1] AS type,
      CASE WHEN (s + v) % 9 = 0 THEN CASE WHEN asr = '' THEN 'isHistorical' ELSE '' END ELSE asr END AS asr
      FROM mention, (SELECT unnest([0, 1, 2, 3]) AS v) WHERE (doc_id * 31 + s * 7 + v * 13) % 10 < 7""",
    "coded": f"""SELECT doc_id, s, e, text, type, CASE WHEN type = '{vocab.DRUG}' THEN (100000 + length(text) * 37 + doc_id % 3)::VARCHAR
      ELSE 'K' || (100 + (length(text) * 7 + doc_id % 2 + s % 3) % 800)::VARCHAR END AS codes FROM mention WHERE type IN ({_CODED})""",
    "cmap": """SELECT surface, type, codes FROM (SELECT *, row_number() OVER (PARTITION BY surface, type ORDER BY n DESC, fd, fs) AS r FROM (
      SELECT lower(trim(text)) AS surface, type, codes, count(*) AS n, min((doc_id, s))[1] AS fd, min((doc_id, s))[2] AS fs FROM coded GROUP BY ALL)) WHERE r = 1""",
    "base": "SELECT doc_id, item_ord AS base_ord, s, e, text, type, asr FROM votes WHERE voter = 'a'",
    "lab": "SELECT doc_id, s, e, type, asr, count(*) AS n, min((voter_ord, item_ord)) AS f, min(text) AS text FROM votes GROUP BY ALL",
    "keyv": "SELECT doc_id, s, e, type, min(text) AS text, count(DISTINCT voter) AS n_votes FROM votes GROUP BY ALL",
    "mode": "SELECT doc_id, s, e, type, asr FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s, e, type ORDER BY n DESC, f) AS r FROM lab) WHERE r = 1",
    "cons": "SELECT k.*, asr FROM keyv k JOIN mode USING (doc_id, s, e, type)",
    "olab": "SELECT doc_id, s, e, type, asr, count(*) AS n, min((voter_ord, item_ord)) AS f FROM votes WHERE voter <> 'a' GROUP BY ALL",
    "omode": "SELECT doc_id, s, e, type, asr, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s, e, type ORDER BY n DESC, f) AS r FROM olab) WHERE r = 1",
    "okey": "SELECT doc_id, s, e, type, min(text) AS text, count(DISTINCT voter) AS n_votes FROM votes WHERE voter <> 'a' GROUP BY ALL",
}
NEEDS = {
    "tok0": ["docs"], "tok": ["tok0"], "men0": ["tok"], "mention": ["men0"], "votes": ["mention"], "coded": ["mention"], "cmap": ["coded"], "base": ["votes"],
    "lab": ["votes"], "keyv": ["votes"], "mode": ["lab"], "cons": ["keyv", "mode"], "olab": ["votes"], "omode": ["olab"], "okey": ["votes"],
}


def sql(select: str, *names: str, recursive: str = "", extra: dict[str, str] | None = None) -> str:
    """``select`` after the CTEs that ``names`` need, then ``extra`` ones, then a recursive one as ``name(cols) AS ...``."""
    seen: list[str] = []

    def need(n: str) -> None:
        for x in NEEDS.get(n, []):
            need(x)
        if n not in seen:
            seen.append(n)

    for n in names:
        need(n)
    parts = [f"{n} AS ({SQL[n]})" for n in seen] + [f"{n} AS ({q})" for n, q in (extra or {}).items()] + ([recursive] if recursive else [])
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select
