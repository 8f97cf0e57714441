"""Queries on votes: scans, consensus, clusters, greedy selection, codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions.text import banned, dot, undot
from spanloom.operators import consensus as C
from spanloom.operators.spans import adjacent_overlaps
from spanloom.plans import views as V
from spanloom.plans.registry import query
from spanloom.sources.tables import table

_OUT = "doc_id, s AS \"start\", e AS \"end\", type"
_TORD = "list_position([" + ", ".join(f"'{t}'" for t in vocab.TYPES) + "], type)"


@query(V.sql(f"SELECT voter, {_OUT}, text, asr AS assertions, item_ord FROM votes", "votes"))
def votes_long(spark, d):
    return V.flat(V.votes(spark, d).select("voter", "doc_id", "start", "end", "type", "text", "assertions", "item_ord"))


def _consensus(k):
    def run(spark, d):
        return V.flat(C.consensus(V.votes(spark, d), k).select("doc_id", "start", "end", "type", "text", "n_votes", "assertions"))

    run.__name__ = f"consensus_k{k}"
    return query(V.sql(f"SELECT {_OUT}, text, n_votes, asr AS assertions FROM cons WHERE n_votes >= {k}", "cons"))(run)


for _k in (1, 2, 3):
    _consensus(_k)

_CLUSTERS = {
    "isl": """SELECT *, sum(opened) OVER (PARTITION BY doc_id, type ORDER BY s, e, voter_ord ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id, type ORDER BY s, e, voter_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opened FROM votes)""",
}


def _cluster_sql(k: int, trusted: str | None) -> str:
    t = f"voter = '{trusted}'" if trusted else "false"
    extra = _CLUSTERS | {
        "head": f"SELECT doc_id, type, island, count(DISTINCT voter) AS support, bool_or({t}) AS has FROM isl GROUP BY ALL",
        "pool": f"SELECT i.* FROM isl i JOIN head USING (doc_id, type, island) WHERE NOT has OR ({t})",
        "bnd": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type, island ORDER BY n DESC, f) AS r FROM (SELECT doc_id, type, island, s, e, count(*) AS n, min((voter_ord, item_ord)) AS f FROM pool GROUP BY ALL)) WHERE r = 1",
        "lb": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type, island ORDER BY n DESC, f) AS r FROM (SELECT doc_id, type, island, asr, count(*) AS n, min((voter_ord, item_ord)) AS f FROM pool GROUP BY ALL)) WHERE r = 1",
    }
    return V.sql(f'SELECT h.doc_id, h.type, s AS "start", e AS "end", support, asr AS assertions FROM head h JOIN bnd USING (doc_id, type, island) JOIN lb USING (doc_id, type, island) WHERE support >= {k} OR has', "votes", extra=extra)


@query(_cluster_sql(2, None))
def consensus_overlap_clusters(spark, d):
    return V.flat(C.cluster_consensus(V.votes(spark, d), 2))


@query(_cluster_sql(3, "b"))
def consensus_trusted(spark, d):
    return V.flat(C.cluster_consensus(V.votes(spark, d), 3, "b"))


def greedy_sql(source: str, order: str, select: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Greedy selection over ``source`` (doc_id, s, e, ...): islands, ranks within them, and a recursion over ranks."""
    more = (extra or {}) | {
        "g0": f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, {_TORD}) AS gid FROM ({source})",
        "g1": """SELECT *, sum(opened) OVER (PARTITION BY doc_id ORDER BY s, e, gid ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *,
          CASE WHEN s < max(e) OVER (PARTITION BY doc_id ORDER BY s, e, gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opened FROM g0)""",
        "g2": f"SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY {order}, gid) AS rn FROM g1",
    }
    rec = """g3(doc_id, island, rn, gid, ok, ks, ke) AS (
      SELECT doc_id, island, rn, gid, true, [s], [e] FROM g2 WHERE rn = 1
      UNION ALL SELECT n.doc_id, n.island, n.rn, n.gid, hits = 0, CASE WHEN hits = 0 THEN list_append(ks, n.s) ELSE ks END, CASE WHEN hits = 0 THEN list_append(ke, n.e) ELSE ke END FROM (
        SELECT b.*, a.ks, a.ke, len(list_filter(list_zip(a.ks, a.ke), lambda x: b.s < x[2] AND b.e > x[1])) AS hits FROM g3 a JOIN g2 b ON a.doc_id = b.doc_id AND a.island = b.island AND b.rn = a.rn + 1) n)"""
    return V.sql(f"SELECT {select} FROM g2 JOIN g3 USING (doc_id, island, rn, gid) WHERE ok", *names, extra=more, recursive=rec)


@query(greedy_sql("SELECT * FROM cons", f"n_votes DESC, e - s, s, {_TORD}", f"{_OUT}, text, n_votes, asr AS assertions", "cons"))
def resolve_overlaps(spark, d):
    return V.flat(C.resolve_overlaps(C.consensus(V.votes(spark, d), 1)))


@query(greedy_sql("SELECT doc_id, s, e, type, text, asr FROM cons", f"s, e, {_TORD}", f"{_OUT}, text, asr AS assertions", "cons"))
def doc_order_dedup(spark, d):
    return V.flat(C.document_order(C.consensus(V.votes(spark, d), 1)))


@query(V.sql("SELECT surface, type, codes FROM cmap", "cmap"))
def code_mode_map(spark, d):
    return V.flat(V.code_map(spark, d))


@query(V.sql(f"SELECT c.doc_id, c.s AS \"start\", c.e AS \"end\", c.type, c.text, n_votes, coalesce(m.codes, '') AS codes FROM cons c LEFT JOIN cmap m ON m.surface = lower(trim(c.text)) AND m.type = c.type WHERE n_votes >= 2", "cons", "cmap"))
def assign_codes(spark, d):
    spans = C.consensus(V.votes(spark, d), 2)
    return V.flat(C.assign_codes(spans, V.code_map(spark, d)).select("doc_id", "start", "end", "type", "text", "n_votes", "codes"))


_CLEAN = """NOT (text ~ '\\*{3,}') AND NOT (lower(trim(text)) = '') AND NOT regexp_matches(text, '^[.,;:]|[.,;:]$|^\\s|\\s$')
  AND length(text) - length(replace(text, '(', '')) = length(text) - length(replace(text, ')', ''))
  AND length(text) - length(replace(text, '[', '')) = length(text) - length(replace(text, ']', ''))"""


@query(
    greedy_sql(
        f"SELECT * FROM cons WHERE n_votes >= 2 AND {_CLEAN}",
        f"n_votes DESC, e - s, s, {_TORD}",
        "type, count(*) AS n, count(codes) AS n_coded, sum(e - s)::BIGINT AS chars, count(DISTINCT doc_id) AS n_docs",
        "cons",
        "cmap",
    ).replace("FROM g2 JOIN g3", "FROM (SELECT g2.*, m.codes FROM g2 LEFT JOIN cmap m ON m.surface = lower(trim(g2.text)) AND m.type = g2.type) g2 JOIN g3")
    + " GROUP BY type"
)
def clean_room_build(spark, d):
    """The flagship: votes, hard rules, two-voter consensus, overlap resolution, codes, counts by type."""
    spans = C.resolve_overlaps(C.consensus(V.votes(spark, d), 2).filter(banned(F.col("text")).isNull()))
    coded = C.assign_codes(spans, V.code_map(spark, d))
    return coded.groupBy("type").agg(
        F.count("*").alias("n"), F.count_if(F.size("codes") > 0).alias("n_coded"), F.sum(F.col("end") - F.col("start")).alias("chars"), F.count_distinct("doc_id").alias("n_docs")
    )


@query(V.sql("SELECT doc_id, count(*)::BIGINT AS n FROM (SELECT doc_id, s, lag(e) OVER (PARTITION BY doc_id ORDER BY s, e, type) AS pe FROM cons) WHERE s < pe GROUP BY doc_id", "cons"))
def adjacent_overlap_count(spark, d):
    return adjacent_overlaps(C.consensus(V.votes(spark, d), 1)).filter("n > 0").select("doc_id", F.col("n").cast("long").alias("n"))


@query("""SELECT p_partkey, upper(left(p_type, 1)) || CAST(100 + p_partkey % 900 AS VARCHAR) AS code,
  upper(left(p_type, 1)) || CAST((100 + p_partkey % 900) // 10 AS VARCHAR) || '.' || CAST((100 + p_partkey % 900) % 10 AS VARCHAR) AS dotted FROM part""")
def code_dot_undot(spark, d):
    code = F.concat(F.upper(F.substring("p_type", 1, 1)), (100 + F.col("p_partkey") % 900).cast("string"))
    dotted = dot(code)
    return table(spark, d, "part").select("p_partkey", undot(dotted).alias("code"), dotted.alias("dotted"))


@query(V.sql("SELECT doc_id FROM votes GROUP BY doc_id HAVING count(DISTINCT voter) = 4", "votes"))
def covered_docs(spark, d):
    return C.covered_docs(V.votes(spark, d))


@query(V.sql("SELECT lower(trim(text)) AS surface, type, count(DISTINCT voter) AS n_voters FROM votes GROUP BY ALL", "votes"))
def surface_support(spark, d):
    return V.flat(C.surface_support(V.votes(spark, d)))


@query(V.sql("SELECT type, lower(trim(text)) AS term, count(*) AS n FROM mention GROUP BY ALL", "mention"))
def distinct_terms_ranked(spark, d):
    return V.mentions(spark, d).groupBy("type", F.lower(F.trim("text")).alias("term")).agg(F.count("*").alias("n"))
