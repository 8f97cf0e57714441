"""Queries that edit, compare, score and check annotation sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions.text import banned, surface
from spanloom.operators import consensus as C
from spanloom.operators import edits as E
from spanloom.operators import metric as M
from spanloom.plans import views as V
from spanloom.plans.registry import query
from spanloom.sources.tables import table

_B = 'doc_id, base_ord, s AS "start", e AS "end", type, text, asr AS assertions'
_K = 'doc_id, s AS "start", e AS "end", type'
_BASE = ["doc_id", "base_ord", "start", "end", "type", "text", "assertions"]
_EXACT = ", ".join(f"'{x}'" for x in vocab.BANNED_EXACT)
_WEAK = ", ".join(f"'{x}'" for x in vocab.ONE_SYLLABLE)
#: Reasons in the order of the hard rules, but for the vital-value pattern, which tests cover.
_REASON = f"""CASE WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(text, '\\*{{3,}}') THEN 'masked' WHEN lower(trim(text)) IN ({_EXACT}) THEN 'banned term'
  WHEN regexp_matches(lower(text), '^\\s*\\d{{1,3}}([.,]\\d+)?\\s*(/\\s*\\d{{1,3}})?\\s*(mmhg|l/p|lần/phút|lan/phut|độ\\s*c|do\\s*c|kg|cm)\\s*$') THEN 'vital value'
  WHEN regexp_matches(text, '^\\s|\\s$') THEN 'edge space' WHEN regexp_matches(text, '^[.,;:]|[.,;:]$') THEN 'edge punctuation'
  WHEN length(replace(text, '(', '')) <> length(replace(text, ')', '')) OR length(replace(text, '[', '')) <> length(replace(text, ']', '')) THEN 'unbalanced bracket' END"""


@query(V.sql(f"SELECT coalesce({_REASON}, 'accepted') AS reason, type, count(*) AS n FROM votes GROUP BY ALL", "votes"))
def ban_reasons(spark, d):
    return V.votes(spark, d).groupBy(F.coalesce(banned(F.col("text")), F.lit("accepted")).alias("reason"), "type").agg(F.count("*").alias("n"))


@query(V.sql(f"SELECT {_B} FROM base b WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.sf = lower(trim(b.text)) AND bad.type = b.type)", "base", extra={"bad": f"SELECT DISTINCT lower(trim(text)) AS sf, type FROM base WHERE {_REASON} IS NOT NULL"}))
def prune_spec(spark, d):
    return V.flat(E.prune_spec(V.base(spark, d)).select(*_BASE))


_OV = {"ov": "SELECT * FROM votes WHERE voter <> 'a'", "cov": "SELECT doc_id FROM ov GROUP BY doc_id HAVING count(DISTINCT voter) = (SELECT count(DISTINCT voter) FROM ov)"}


def _uncorroborated(min_votes: int) -> dict[str, str]:
    return _OV | {
        "seen": f"SELECT b.*, lower(trim(text)) AS sf FROM base b WHERE doc_id IN (SELECT doc_id FROM cov) AND {_REASON} IS NULL AND lower(trim(text)) NOT IN ({_WEAK})",
        "sup": "SELECT lower(trim(text)) AS sf, type, count(DISTINCT voter) AS n FROM ov GROUP BY ALL",
        "near": "SELECT n.sf, n.type, n.doc_id, n.base_ord, count(DISTINCT o.voter) AS n FROM seen n JOIN ov o ON o.doc_id = n.doc_id AND o.s < n.e AND o.e > n.s GROUP BY ALL",
        "bad": f"SELECT DISTINCT sf, type FROM seen EXCEPT SELECT sf, type FROM sup WHERE n >= {min_votes} EXCEPT SELECT sf, type FROM near WHERE n >= {min_votes}",
    }


@query(V.sql(f"SELECT {_B} FROM base b WHERE NOT (doc_id IN (SELECT doc_id FROM cov) AND EXISTS (SELECT 1 FROM bad WHERE bad.sf = lower(trim(b.text)) AND bad.type = b.type))", "base", extra=_uncorroborated(2)))
def prune_uncorroborated(spark, d):
    return V.flat(E.prune_uncorroborated(V.base(spark, d), V.others(spark, d), 2).select(*_BASE))


_OCONS = {"oc": "SELECT k.*, m.asr FROM okey k JOIN omode m USING (doc_id, s, e, type)"}


@query(
    V.sql(
        f"SELECT {_K}, text, n_votes, asr AS assertions FROM oc c WHERE n_votes >= 2 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND b.e > c.s)",
        "base", "okey", "omode", extra=_OCONS,
    )
)
def augment_k2(spark, d):
    return V.flat(E.augment(V.base(spark, d), V.others(spark, d), 2).select("doc_id", "start", "end", "type", "text", "n_votes", "assertions"))


def _fix_spans(both: bool) -> str:
    longer = "" if both else "AND re - rs < e - s"
    extra = {
        "alt": "SELECT * FROM okey k WHERE n_votes >= 2 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = k.doc_id AND b.s = k.s AND b.e = k.e)",
        "best": """SELECT * FROM (SELECT b.*, a.s AS rs, a.e AS re, a.type AS rt, a.text AS rx, row_number() OVER (PARTITION BY b.doc_id, b.base_ord
          ORDER BY least(a.e, b.e) - greatest(a.s, b.s) DESC, a.s, a.e, a.type) AS r FROM base b JOIN alt a ON a.doc_id = b.doc_id AND a.s < b.e AND a.e > b.s) WHERE r = 1""",
        "won": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rs, re ORDER BY base_ord) AS w FROM best WHERE true {longer}) WHERE w = 1",
    }
    return V.sql(
        'SELECT b.doc_id, b.base_ord, coalesce(rs, b.s) AS "start", coalesce(re, b.e) AS "end", coalesce(rt, b.type) AS type, coalesce(rx, b.text) AS text, b.asr AS assertions, rs IS NOT NULL AS changed '
        "FROM base b LEFT JOIN won w ON w.doc_id = b.doc_id AND w.base_ord = b.base_ord",
        "base", "okey", extra=extra,
    )


@query(_fix_spans(False))
def fix_spans_k2(spark, d):
    return V.flat(E.fix_spans(V.base(spark, d), V.others(spark, d), 2).select(*_BASE, "changed"))


@query(_fix_spans(True))
def fix_spans_both(spark, d):
    return V.flat(E.fix_spans(V.base(spark, d), V.others(spark, d), 2, both=True).select(*_BASE, "changed"))


@query(
    V.sql(
        """SELECT b.doc_id, b.base_ord, CASE WHEN won THEN ns ELSE s END AS "start", CASE WHEN won THEN ne ELSE e END AS "end", type, CASE WHEN won THEN new ELSE text END AS text,
          CASE WHEN new IS NULL THEN 'no proposal' WHEN NOT fits THEN 'not a shorter piece' WHEN NOT won THEN 'bounds taken' ELSE 'tightened' END AS outcome
        FROM (SELECT *, fits AND row_number() OVER (PARTITION BY doc_id, fits, ns, ne ORDER BY base_ord) = 1 AS won FROM j) b""",
        "base",
        extra={
            "prop": "SELECT DISTINCT doc_id, text AS old, CASE WHEN doc_id % 7 = 0 THEN text ELSE split_part(text, ' ', 1) END AS new FROM base WHERE doc_id % 2 = 0",
            "j": """SELECT b.*, new, coalesce(length(new) > 0 AND length(new) < length(text) AND instr(text, new) > 0, false) AS fits, s + instr(text, new) - 1 AS ns, s + instr(text, new) - 1 + length(new) AS ne
              FROM base b LEFT JOIN prop p ON p.doc_id = b.doc_id AND p.old = b.text""",
        },
    )
)
def tighten_spans(spark, d):
    base = V.base(spark, d)
    new = F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(F.split_part("text", F.lit(" "), F.lit(1)))
    proposals = base.filter("doc_id % 2 = 0").select("doc_id", F.col("text").alias("old"), new.alias("new")).distinct()
    return V.flat(E.tighten(base, proposals).select("doc_id", "base_ord", "start", "end", "type", "text", "outcome"))


def _fix_labels(add: bool) -> str:
    keep = "AND len(list_filter(string_split(b.asr, '|'), lambda x: x <> '' AND NOT list_contains(string_split(m.asr, '|'), x))) = 0" if add else ""
    change = f"m.asr IS NOT NULL AND m.asr <> b.asr {keep}"
    return V.sql(
        f'SELECT b.doc_id, b.base_ord, b.s AS "start", b.e AS "end", b.type, b.text, CASE WHEN {change} THEN m.asr ELSE b.asr END AS assertions, {change} AS changed '
        "FROM base b LEFT JOIN (SELECT * FROM omode WHERE n >= 2) m ON m.doc_id = b.doc_id AND m.s = b.s AND m.e = b.e AND m.type = b.type",
        "base", "omode",
    )


def _reversed(votes):
    """Every other voter names its labels in the other order, which is the same set."""
    return votes.withColumn("assertions", F.when(F.col("voter_ord") % 2 == 1, F.reverse("assertions")).otherwise(F.col("assertions")))


@query(_fix_labels(False))
def fix_assertions_full(spark, d):
    return V.flat(E.fix_assertions(V.base(spark, d), _reversed(V.others(spark, d)), 2).select(*_BASE, "changed"))


@query(_fix_labels(True))
def fix_assertions_add(spark, d):
    return V.flat(E.fix_assertions(V.base(spark, d), _reversed(V.others(spark, d)), 2, "add").select(*_BASE, "changed"))


@query(
    V.sql(
        'SELECT b.doc_id, b.base_ord, b.s AS "start", b.e AS "end", coalesce(t.lo, b.type) AS type, b.text, b.asr AS assertions, coalesce(t.lo <> b.type, false) AS changed FROM base b LEFT JOIN tv t ON t.doc_id = b.doc_id AND t.s = b.s AND t.e = b.e',
        "base", extra={"tv": "SELECT doc_id, s, e, min(type) AS lo FROM votes WHERE voter <> 'a' GROUP BY ALL HAVING count(*) >= 2 AND min(type) = max(type)"},
    )
)
def fix_types(spark, d):
    return V.flat(E.fix_types(V.base(spark, d), V.others(spark, d), 2).select(*_BASE, "changed"))


_SETS = {
    "ga": "SELECT b.*, coalesce(m.codes, '') AS codes FROM base b LEFT JOIN cmap m ON m.surface = lower(trim(b.text)) AND m.type = b.type",
    "p0": "SELECT k.*, m.asr FROM okey k JOIN omode m USING (doc_id, s, e, type) WHERE n_votes >= 2",
    "pb": "SELECT b.*, coalesce(m.codes, '') AS codes FROM p0 b LEFT JOIN cmap m ON m.surface = lower(trim(b.text)) AND m.type = b.type",
}


def _gold(spark, d):
    return C.assign_codes(V.base(spark, d), V.code_map(spark, d)).withColumnRenamed("base_ord", "ord").select("doc_id", "ord", "start", "end", "type", "text", "assertions", "codes")


def _pred(spark, d):
    spans = C.assign_codes(C.consensus(V.others(spark, d), 2), V.code_map(spark, d))
    order = Window.partitionBy("doc_id").orderBy("start", "end", "type")
    return spans.withColumn("ord", F.row_number().over(order)).select("doc_id", "ord", "start", "end", "type", "text", "assertions", "codes")


@query(
    V.sql(
        """SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.s, p.s) AS "start", coalesce(g.e, p.e) AS "end", coalesce(g.type, p.type) AS type,
        CASE WHEN g.doc_id IS NULL THEN 'added' WHEN p.doc_id IS NULL THEN 'removed' WHEN g.asr <> p.asr THEN 'labels' WHEN g.codes <> p.codes THEN 'codes' ELSE 'same' END AS status
        FROM ga g FULL JOIN pb p ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.type = p.type""",
        "base", "okey", "omode", "cmap", extra=_SETS,
    )
)
def diff_sets(spark, d):
    return V.flat(E.diff(_gold(spark, d), _pred(spark, d)))


# ---- edits of a coded set: changed rows are coded anew
_CODED = [*_BASE, "codes"]
_CB = 'b.doc_id, b.base_ord, b.s AS "start", b.e AS "end", b.type, b.text, b.asr AS assertions'
_CODES_OF = "coalesce((SELECT max(codes) FROM cmap m WHERE m.surface = lower(trim({0})) AND m.type = {1}), '')"


def _coded_base(spark, d):
    return _gold(spark, d).withColumnRenamed("ord", "base_ord").select(*_CODED)


@query(
    V.sql(
        f"SELECT {_K}, text, n_votes, c.asr AS assertions, coalesce(m.codes, '') AS codes FROM oc c LEFT JOIN (SELECT surface, type AS mt, codes FROM cmap) m ON m.surface = lower(trim(c.text)) AND m.mt = c.type "
        "WHERE n_votes >= 2 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND b.e > c.s)",
        "base", "okey", "omode", "cmap", extra=_OCONS,
    )
)
def augment_coded(spark, d):
    out = E.augment(V.base(spark, d), V.others(spark, d), 2, codes=V.code_map(spark, d))
    return V.flat(out.select("doc_id", "start", "end", "type", "text", "n_votes", "assertions", "codes"))


@query(
    _fix_spans(True).rsplit("SELECT b.doc_id", 1)[0].rstrip()
    + ",\n"
    + ",\n".join(f"{n} AS ({V.SQL[n]})" for n in ("coded", "cmap"))
    + f""",\nga AS ({_SETS["ga"]}),
fixed AS (SELECT b.doc_id, b.base_ord, coalesce(rs, b.s) AS s, coalesce(re, b.e) AS e, coalesce(rt, b.type) AS type, coalesce(rx, b.text) AS text, b.asr, b.codes AS old, rs IS NOT NULL AS changed
  FROM ga b LEFT JOIN won w ON w.doc_id = b.doc_id AND w.base_ord = b.base_ord)
SELECT doc_id, base_ord, s AS "start", e AS "end", f.type, text, asr AS assertions, CASE WHEN changed THEN coalesce(m.codes, '') ELSE old END AS codes
FROM fixed f LEFT JOIN cmap m ON m.surface = lower(trim(f.text)) AND m.type = f.type"""
)
def fix_spans_coded(spark, d):
    return V.flat(E.fix_spans(_coded_base(spark, d), V.others(spark, d), 2, both=True, codes=V.code_map(spark, d)).select(*_CODED))


@query(
    V.sql(
        """SELECT t.doc_id, t.base_ord, CASE WHEN won THEN ns ELSE s END AS "start", CASE WHEN won THEN ne ELSE e END AS "end", t.type, CASE WHEN won THEN new ELSE t.text END AS text, asr AS assertions,
          CASE WHEN won THEN coalesce(m.codes, '') ELSE t.codes END AS codes,
          CASE WHEN new IS NULL THEN 'no proposal' WHEN NOT fits THEN 'not a shorter piece' WHEN NOT ok THEN 'not verbatim' WHEN NOT won THEN 'bounds taken' ELSE 'tightened' END AS outcome
        FROM (SELECT *, ok AND row_number() OVER (PARTITION BY doc_id, ok, ns, ne ORDER BY base_ord) = 1 AS won FROM v) t LEFT JOIN cmap m ON m.surface = lower(trim(t.new)) AND m.type = t.type""",
        "base", "cmap", "docs",
        extra={
            "gb": "SELECT b.* EXCLUDE (s, e), s + CASE WHEN s % 31 = 0 THEN 1 ELSE 0 END AS s, e + CASE WHEN s % 31 = 0 THEN 1 ELSE 0 END AS e, coalesce(m.codes, '') AS codes FROM base b LEFT JOIN cmap m ON m.surface = lower(trim(b.text)) AND m.type = b.type",
            "prop": "SELECT DISTINCT doc_id, text AS old, CASE WHEN doc_id % 7 = 0 THEN text ELSE split_part(text, ' ', 1) END AS new FROM base WHERE doc_id % 2 = 0",
            "j": """SELECT b.*, new, coalesce(length(new) > 0 AND length(new) < length(text) AND instr(text, new) > 0, false) AS fits, s + instr(text, new) - 1 AS ns, s + instr(text, new) - 1 + length(new) AS ne
              FROM gb b LEFT JOIN prop p ON p.doc_id = b.doc_id AND p.old = b.text""",
            "v": "SELECT j.*, fits AND coalesce(substr(body, ns + 1, ne - ns) = new, false) AS ok FROM j JOIN docs USING (doc_id)",
        },
    )
)
def tighten_coded(spark, d):
    """Codes of the shorter texts, and bounds that are off by one now and then, which must not be tightened."""
    base = _coded_base(spark, d)
    new = F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(F.split_part("text", F.lit(" "), F.lit(1)))
    proposals = base.filter("doc_id % 2 = 0").select("doc_id", F.col("text").alias("old"), new.alias("new")).distinct()
    off = F.when(F.col("start") % 31 == 0, 1).otherwise(0)
    base = base.withColumn("_off", off).withColumn("start", F.col("start") + F.col("_off")).withColumn("end", F.col("end") + F.col("_off")).drop("_off")
    return V.flat(E.tighten(base, proposals, V.docs(spark, d), V.code_map(spark, d)).select(*_CODED, "outcome"))


@query(
    V.sql(
        f"""SELECT {_CB.replace("b.type", "coalesce(t.lo, b.type) AS type")}, CASE WHEN coalesce(t.lo <> b.type, false) AND t.lo NOT IN ('{vocab.DIAGNOSIS}', '{vocab.DRUG}') THEN '' ELSE codes END AS codes
        FROM ga b LEFT JOIN tv t ON t.doc_id = b.doc_id AND t.s = b.s AND t.e = b.e""",
        "base", "cmap", extra={"ga": _SETS["ga"], "tv": "SELECT doc_id, s, e, min(type) AS lo FROM votes WHERE voter <> 'a' GROUP BY ALL HAVING count(*) >= 2 AND min(type) = max(type)"},
    )
)
def fix_types_coded(spark, d):
    return V.flat(E.fix_types(_coded_base(spark, d), V.others(spark, d), 2).select(*_CODED))


@query(
    V.sql(
        f"SELECT {_B} FROM base b WHERE NOT (b.type IN ('{vocab.DRUG}', '{vocab.SYMPTOM}') AND doc_id IN (SELECT doc_id FROM cov) AND EXISTS (SELECT 1 FROM bad WHERE bad.sf = lower(trim(b.text)) AND bad.type = b.type))",
        "base", extra=_uncorroborated(2),
    )
)
def prune_some_types(spark, d):
    return V.flat(E.prune_uncorroborated(V.base(spark, d), V.others(spark, d), 2, types=(vocab.DRUG, vocab.SYMPTOM)).select(*_BASE))


@query(V.sql(f"SELECT {_B} FROM base WHERE lower(trim(text)) NOT IN ({_WEAK})", "base"))
def prune_weak(spark, d):
    return V.flat(E.prune_weak(V.base(spark, d)).select(*_BASE))


_MODE_KEYS = {"text_type": "lt, type", "pos_type": "s, e, type", "text_pos_type": "lt, s, e, type"}


def _pairs_cte(mode: str) -> dict[str, str]:
    keys = _MODE_KEYS[mode]
    on = " AND ".join(f"g.{c.strip()} = p.{c.strip()}" for c in ("doc_id, " + keys + ", n").split(","))
    return _SETS | {
        "gn": f"SELECT *, row_number() OVER (PARTITION BY doc_id, {keys} ORDER BY base_ord) AS n FROM (SELECT *, lower(trim(text)) AS lt FROM ga)",
        "pn": f"SELECT *, row_number() OVER (PARTITION BY doc_id, {keys} ORDER BY s, e, type) AS n FROM (SELECT *, lower(trim(text)) AS lt FROM pb WHERE doc_id IN (SELECT doc_id FROM ga))",
        "pr": f"SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, g.doc_id IS NOT NULL AS ing, p.doc_id IS NOT NULL AS inp, g.text AS gt, p.text AS pt, g.asr AS gasr, p.asr AS pasr, g.codes AS gc, p.codes AS pc FROM gn g FULL JOIN pn p ON {on}",
    }


def _set(c: str) -> str:
    return f"list_filter(string_split(coalesce({c}, ''), '|'), lambda x: x <> '')"


def _jac(a: str, b: str) -> str:
    return f"CASE WHEN NOT (ing AND inp) THEN 0.0 WHEN len({_set(a)}) = 0 AND len({_set(b)}) = 0 THEN 1.0 ELSE len(list_intersect({_set(a)}, {_set(b)})) / len(list_distinct(list_concat({_set(a)}, {_set(b)})))::DOUBLE END"


@query(V.sql("SELECT doc_id, count(*) FILTER (ing AND inp) AS pairs, count(*) FILTER (NOT inp) AS missed, count(*) FILTER (NOT ing) AS spurious FROM pr GROUP BY doc_id", "base", "okey", "omode", "cmap", extra=_pairs_cte("text_type")))
def align_multiset(spark, d):
    gold, pred = _gold(spark, d), _pred(spark, d)
    pairs = M.align(gold, pred.join(gold.select("doc_id").distinct(), "doc_id", "left_semi"), ["text_type"])
    return pairs.groupBy("doc_id").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("pairs"), F.count_if(F.col("p").isNull()).alias("missed"), F.count_if(F.col("g").isNull()).alias("spurious"))


def _jaccard_query(name: str, a: str, b: str, column: str):
    def run(spark, d):
        gold = _gold(spark, d)
        s = M.sample_scores(gold, _pred(spark, d), gold.select("doc_id").distinct(), ["pos_type"], ("per_concept",))
        return s.select("doc_id", F.round(column, 6).alias("score"))

    run.__name__ = name
    return query(V.sql(f"SELECT doc_id, round(avg({_jac(a, b)}), 6) AS score FROM pr GROUP BY doc_id", "base", "okey", "omode", "cmap", extra=_pairs_cte("pos_type")))(run)


_jaccard_query("jaccard_assertions", "gasr", "pasr", "assertions")
_jaccard_query("jaccard_codes", "gc", "pc", "codes")

_WORDS = "list_filter(string_split_regex(coalesce({0}, ''), '\\s+'), lambda x: x <> '')"
_ENC = "array_to_string(list_transform({0}, lambda w: chr(64 + list_position(list_concat({1}, {2}), w)::INTEGER)), '')"


#: The table of the distance of two documents' words, a row of it in each step of the recursion.
_CONCAT = {
    "gl": f"SELECT doc_id, {_WORDS.format("string_agg(text, ' ' ORDER BY s, base_ord)")} AS l FROM ga GROUP BY doc_id",
    "pl": f"SELECT doc_id, {_WORDS.format("string_agg(text, ' ' ORDER BY s, e, type)")} AS l FROM pb GROUP BY doc_id",
    "gw": "SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM gl",
    "pw": "SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS j FROM pl",
    "size": "SELECT g.doc_id, len(g.l) AS n, coalesce(len(p.l), 0) AS m FROM gl g LEFT JOIN pl p USING (doc_id)",
    "dp": """SELECT doc_id, 0::BIGINT AS i, unnest(range(m + 1)) AS j, unnest(range(m + 1)) AS v FROM size
      UNION ALL SELECT doc_id, i + 1, j, j + min(t - j) OVER (PARTITION BY doc_id ORDER BY j) FROM (
        SELECT d.doc_id, d.i, d.j, CASE WHEN d.j = 0 THEN d.i + 1 ELSE least(d.v + 1, lag(d.v) OVER (PARTITION BY d.doc_id ORDER BY d.j) + CASE WHEN g.w = p.w THEN 0 ELSE 1 END) END AS t
        FROM dp d JOIN gw g ON g.doc_id = d.doc_id AND g.i = d.i + 1 LEFT JOIN pw p ON p.doc_id = d.doc_id AND p.j = d.j)""",
    "cd": "SELECT doc_id, CASE WHEN n > 0 THEN 1 - v / n::DOUBLE WHEN m = 0 THEN 1.0 ELSE '-inf'::DOUBLE END AS t FROM size JOIN dp USING (doc_id) WHERE i = n AND j = m",
}


def _final_sql(concat: bool = False) -> str:
    parts = []
    ctes: dict[str, str] = {}
    g, p = _WORDS.format("gt"), _WORDS.format("pt")
    text_mode = "concat" if concat else "per_concept"
    w = "cd.t" if concat else f"CASE WHEN NOT (ing AND inp) THEN 0.0 ELSE 1 - levenshtein({_ENC.format(g, g, p)}, {_ENC.format(p, g, p)}) / len({g})::DOUBLE END"
    for mode in _MODE_KEYS:
        if concat:
            ctes |= _SETS | _CONCAT
        for k, v in _pairs_cte(mode).items():
            if k in _SETS:
                ctes[k] = v
            else:
                ctes[f"{k}_{mode}"] = v.replace("FROM gn g FULL JOIN pn p", f"FROM gn_{mode} g FULL JOIN pn_{mode} p")
        ctes[f"doc_{mode}"] = f"SELECT doc_id, avg({w}) AS t, avg({_jac('gasr', 'pasr')}) AS a, avg({_jac('gc', 'pc')}) AS c, sum(CASE WHEN ing THEN len({_set('gc')}) + 1 ELSE 0 END) AS w FROM pr_{mode} {'JOIN cd USING (doc_id)' if concat else ''} GROUP BY doc_id"
        parts.append(f"SELECT '{mode}' AS mode, '{text_mode}' AS text_mode, round(avg(t), 6) AS text_score, round(avg(a), 6) AS assertions_score, round(sum(c * w) / sum(w), 6) AS candidates_score, round(0.3 * avg(t) + 0.3 * avg(a) + 0.4 * sum(c * w) / sum(w), 6) AS final_score FROM doc_{mode}")
    return V.sql(" UNION ALL ".join(parts), "base", "okey", "omode", "cmap", extra=ctes)


def _rounded(df):
    return df.select("mode", "text_mode", *[F.round(c, 6).alias(c) for c in ("text_score", "assertions_score", "candidates_score", "final_score")])


@query(_final_sql())
def evaluate_final(spark, d):
    gold, pred = _gold(spark, d), _pred(spark, d)
    return _rounded(M.evaluate(gold, pred, gold.select("doc_id").distinct(), text_modes=("per_concept",)))


@query(_final_sql(concat=True))
def evaluate_concat(spark, d):
    """Word error rate of whole documents."""
    gold, pred = _gold(spark, d), _pred(spark, d)
    return _rounded(M.evaluate(gold, pred, gold.select("doc_id").distinct(), text_modes=("concat",)))


@query(V.sql("SELECT doc_id, round(t, 6) AS text_score, w AS weight FROM cd JOIN (SELECT doc_id, sum(len({set}) + 1)::BIGINT AS w FROM ga GROUP BY doc_id) USING (doc_id)".format(set=_set("codes")), "base", "okey", "omode", "cmap", extra=_SETS | _CONCAT))
def wer_concat(spark, d):
    gold, pred = _gold(spark, d), _pred(spark, d)
    return M.sample_scores(gold, pred, gold.select("doc_id").distinct(), ["text_type"], ("concat",)).select("doc_id", F.round("text", 6).alias("text_score"), "weight")


_PROBES = {
    "empty": f"SELECT {_B} FROM base WHERE false",
    "first": f"SELECT {_B} FROM one",
    "wrong_type": "SELECT doc_id, base_ord, s AS \"start\", e AS \"end\", CASE type WHEN 'THUỐC' THEN 'TRIỆU_CHỨNG' WHEN 'TRIỆU_CHỨNG' THEN 'CHẨN_ĐOÁN' ELSE 'TRIỆU_CHỨNG' END AS type, text, asr AS assertions FROM one",
    "shift": 'SELECT doc_id, base_ord, s + 1 AS "start", e + 1 AS "end", type, text, asr AS assertions FROM one',
    "duplicate": f"SELECT {_B} FROM one UNION ALL SELECT {_B} FROM one",
    "reverse": 'SELECT doc_id, count(*) OVER (PARTITION BY doc_id) + 1 - row_number() OVER (PARTITION BY doc_id ORDER BY s, base_ord) AS base_ord, s AS "start", e AS "end", type, text, asr AS assertions FROM base',
    "no_labels": "SELECT doc_id, base_ord, s AS \"start\", e AS \"end\", type, text, '' AS assertions FROM base",
    "constant:isHistorical": "SELECT doc_id, base_ord, s AS \"start\", e AS \"end\", type, text, 'isHistorical' AS assertions FROM base",
}


def _probe(kind: str, select: str):
    def run(spark, d):
        return V.flat(E.probe(V.base(spark, d), kind).select(*_BASE))

    run.__name__ = "probe_" + kind.split(":")[0].replace("constant", "const_assert")
    return query(V.sql(select, "base", extra={"one": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, base_ord) AS r FROM base) WHERE r = 1"}))(run)


for _kind, _select in _PROBES.items():
    _probe(_kind, _select)


@query(
    V.sql(
        f"""SELECT {_K}, CASE WHEN type = '{vocab.SYMPTOM}' THEN '99999999' ELSE codes END AS fake_codes,
        CASE WHEN type = '{vocab.DIAGNOSIS}' AND length(codes) > 3 THEN left(codes, 3) || '.' || substr(codes, 4) ELSE codes END AS dotted_codes FROM ga""",
        "base", "cmap", extra={"ga": _SETS["ga"]},
    )
)
def probe_codes(spark, d):
    gold = _gold(spark, d).withColumnRenamed("ord", "base_ord")
    fake = E.probe(gold, "fake_codes").select(*C.KEY, F.array_join("codes", "|").alias("fake_codes"))
    dotted = E.probe(gold, "dotted_codes").select(*C.KEY, F.array_join("codes", "|").alias("dotted_codes"))
    return V.flat(fake.join(dotted, C.KEY))


@query(V.sql("SELECT surface, g.type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ga g WHERE codes = '' AND g.type IN ('THUỐC', 'CHẨN_ĐOÁN') GROUP BY ALL", "base", "cmap", extra={"ga": "SELECT b.*, lower(trim(b.text)) AS surface, coalesce(m.codes, '') AS codes FROM base b LEFT JOIN cmap m ON m.surface = lower(trim(b.text)) AND m.type = b.type"}))
def uncoded_worklist(spark, d):
    gold = _gold(spark, d).filter((F.size("codes") == 0) & F.col("type").isin(*vocab.CODED_TYPES))
    return gold.groupBy(surface(F.col("text")).alias("surface"), "type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("SELECT lang, source, quality, toxic, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def labelled_quality_report(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return joined.groupBy("lang", "source", "quality", "toxic").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
