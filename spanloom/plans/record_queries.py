"""Queries on dictionaries, gates, codecs, samples, search and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions.text import break_even
from spanloom.operators import consensus as C
from spanloom.operators import linking as K
from spanloom.operators import locate as L
from spanloom.operators import records as R
from spanloom.operators import search as Q
from spanloom.plans import views as V
from spanloom.plans.consensus_queries import greedy_sql
from spanloom.plans.registry import query
from spanloom.sources.tables import table

_DICT = {
    "dict": "SELECT DISTINCT lower(text) AS gram, length(text) AS value FROM mention WHERE length(text) % 3 = 0",
    "ng": """SELECT doc_id, s, s + length(g) AS e, n, lower(g) AS gram FROM (SELECT doc_id, s, 1 AS n, w AS g FROM tok UNION ALL SELECT doc_id, s, 2, w || ' ' || w1 FROM tok WHERE w1 IS NOT NULL
      UNION ALL SELECT doc_id, s, 3, w || ' ' || w1 || ' ' || w2 FROM tok WHERE w2 IS NOT NULL)""",
    "dh": "SELECT ng.*, value, 'THUỐC' AS type FROM ng JOIN dict USING (gram)",
}


def _dictionary(spark, d):
    return V.mentions(spark, d).filter("length(text) % 3 = 0").select(F.lower("text").alias("gram"), F.length("text").alias("value")).distinct()


def _hits(spark, d):
    return K.known_ngrams(V.tokens(spark, d, 2), _dictionary(spark, d))


@query(greedy_sql("SELECT * FROM dh", "s, n DESC", 'doc_id, s AS "start", e AS "end", gram, value, n', "mention", extra=_DICT))
def dict_ngram_longest(spark, d):
    return V.flat(K.known_longest(V.tokens(spark, d, 2), _dictionary(spark, d)))


@query(greedy_sql("SELECT * FROM dh", "length(gram) DESC, n, s", 'doc_id, s AS "start", e AS "end", gram AS term', "mention", extra=_DICT))
def lexicon_longest_first(spark, d):
    hits, claim = _hits(spark, d)
    hits = hits.select("doc_id", "start", "end", F.col("gram").alias("term"), F.col("n").alias("term_ord"))
    return V.flat(K.lexicon_longest_first(hits, claim).drop("term_ord"))


@query(greedy_sql("SELECT * FROM dh", "length(gram) % 4, e - s DESC, s", 'doc_id, s AS "start", e AS "end", length(gram) % 4 AS layer, gram AS term', "mention", extra=_DICT))
def layered_claim(spark, d):
    hits, claim = _hits(spark, d)
    hits = hits.select("doc_id", "start", "end", F.col("gram").alias("term"), (F.length("gram") % 4).alias("layer"))
    return V.flat(K.layered_claim(hits, claim))


@query(greedy_sql("SELECT * FROM dh h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.s < h.e AND b.e > h.s)", "e - s DESC, s", 'doc_id, s AS "start", e AS "end", gram AS text', "mention", "base", extra=_DICT))
def repeat_expansion(spark, d):
    hits = _hits(spark, d)[0].select("doc_id", "start", "end", F.col("gram").alias("text"), F.lit(vocab.DRUG).alias("type"))
    return V.flat(K.repeats(V.base(spark, d).select("doc_id", "start", "end"), hits).drop("type"))


@query("""SELECT p_partkey, lower(split_part(p_type, ' ', 1)) AS ingredient, (p_partkey % 90 + 1) || ' mg' AS strength, 'oral tablet' AS form,
  lower(split_part(p_type, ' ', 1)) AS base, lower(p_brand) AS brand FROM part""")
def parse_clinical_name(spark, d):
    first = F.split_part("p_type", F.lit(" "), F.lit(1))
    name = F.concat(F.lit("24 HR "), first, F.lit(" sodium "), (F.col("p_partkey") % 90 + 1).cast("string"), F.lit(" MG Oral Tablet"))
    p = table(spark, d, "part").select("p_partkey", K.clinical_name(name).alias("p"), K.brand(F.concat(name, F.lit(" ["), "p_brand", F.lit("]"))).alias("brand"))
    return p.select("p_partkey", K.strip_salt(F.col("p.ingredient")).alias("ingredient"), "p.strength", "p.form", K.strip_salt(F.concat("p.ingredient", F.lit(" sodium hydrochloride"))).alias("base"), "brand")


#: Invented names.
_CLINICAL = [("avenol", "10 mg", "oral tablet", "101"), ("avenol", "20 mg", "oral capsule", "102"), ("brixin", "5 mg", "injection", "103"), ("corvan tartrate", "25 mg", "oral tablet", "104"), ("corvan succinate", "50 mg", "extended release oral tablet", "105"), ("duomal", "1 mg", "oral tablet", "106"), ("duomal", "1 mg", "injection", "107")]
_INGREDIENTS = [("avenol", "1"), ("brixin", "2"), ("corvan", "3"), ("duomal", "4")]
_SPANS = [(1, "avenol 10 mg po daily", "avenol"), (2, "avenol 20mg po", "avenol"), (3, "brixin 5 mg", "brixin"), (4, "corvan 25 mg po", "corvan"), (5, "corvan XL 50 mg po", "corvan succinate"), (6, "duomal 1 mg", "duomal"), (7, "avenol sodium", "avenol sodium"), (8, "brixin / avenol", "brixin / avenol"), (9, "unknown 3 mg", "unknown")]


@query("SELECT * FROM (VALUES (1, '101', 1), (2, '102', 2), (3, '103', 5), (4, '104', 6), (5, '105', 1), (6, '4', 7), (7, '1', 8), (8, '2', 9), (9, NULL, NULL)) t(id, code, tier)")
def code_two_tier(spark, d):
    clinical = spark.createDataFrame(_CLINICAL, "ingredient string, strength string, form string, code string")
    out = K.resolve_codes(spark.createDataFrame(_SPANS, "id int, text string, ingredient string"), clinical, spark.createDataFrame(_INGREDIENTS, "name string, code string"))
    return V.flat(out)


@query("SELECT * FROM (VALUES (1, 21), (2, 13), (3, 6), (4, 17)) t(id, \"end\")")
def expand_span(spark, d):
    rows = [(1, "avenol 10 mg po daily", 6), (2, "avenol, 10 mg cho ho", 6), (3, "avenol và brixin", 6), (4, "avenol 325-650 mg,", 6)]
    t = spark.createDataFrame([(i, s, e) for i, s, e in rows], "id int, text string, e int")
    return V.flat(t.select("id", K.expand_end(F.col("text"), F.col("e")).alias("end")))


_SENTENCES = [
    (1, "Bệnh nhân không có sốt", 19, 22, False), (2, "sốt từ hôm qua", 0, 3, False), (3, "bệnh gút không đặc hiệu kèm đau", 28, 31, False), (4, "Mẹ bị hen", 6, 9, False),
    (5, "tiền sử hen", 8, 11, False), (6, "không có sốt. Ho nhiều", 14, 16, False), (7, "hen", 0, 3, True), (8, "nghi ngờ hen", 9, 12, False), (9, "không có ho nhưng sốt", 18, 21, False),
]


@query("SELECT * FROM (VALUES (1, 'isNegated'), (2, ''), (3, ''), (4, 'isFamily'), (5, 'isHistorical'), (6, ''), (7, 'isHistorical'), (8, 'isUncertain'), (9, '')) t(id, flags)")
def context_flags(spark, d):
    rows = spark.createDataFrame(_SENTENCES, "id int, sentence string, start int, end int, historical boolean")
    return V.flat(K.context_flags(rows).select("id", "flags"))


_FAULTY = {
    "fb": f"""SELECT b.doc_id, base_ord AS ord, s, e, CASE WHEN s % 50 = 0 THEN 'other' ELSE b.type END AS type, CASE WHEN s % 53 = 0 THEN text || 'x' ELSE text END AS text,
      CASE WHEN s % 51 = 0 THEN 'isUncertain' ELSE asr END AS asr, CASE WHEN b.type IN ('{vocab.DIAGNOSIS}', '{vocab.DRUG}') THEN coalesce(m.codes, '') ELSE CASE WHEN s % 57 = 0 THEN '1' ELSE '' END END AS codes
      FROM base b LEFT JOIN cmap m ON m.surface = lower(trim(b.text)) AND m.type = b.type""",
    "known": "SELECT DISTINCT type, codes AS code FROM cmap WHERE length(surface) % 2 = 0",
    "want": "SELECT doc_id FROM documents WHERE doc_id % 100 <> 0",
}


@query(
    V.sql(
        f"""SELECT doc_id, ord, 'unknown type' AS rule FROM fb WHERE type = 'other' UNION ALL SELECT doc_id, ord, 'unknown assertion' FROM fb WHERE asr = 'isUncertain'
        UNION ALL SELECT doc_id, ord, 'text' FROM fb JOIN docs USING (doc_id) WHERE substr(body, s + 1, e - s) <> text
        UNION ALL SELECT doc_id, ord, 'codes on an uncoded type' FROM fb WHERE type NOT IN ('{vocab.DIAGNOSIS}', '{vocab.DRUG}') AND codes <> ''
        UNION ALL SELECT doc_id, ord, 'undotted code' FROM fb WHERE type = '{vocab.DIAGNOSIS}' AND length(codes) > 3 AND instr(codes, '.') = 0
        UNION ALL SELECT doc_id, ord, 'unknown code' FROM fb WHERE type IN ('{vocab.DIAGNOSIS}', '{vocab.DRUG}') AND codes <> '' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.type = fb.type AND k.code = codes)
        UNION ALL SELECT doc_id, NULL, 'overlaps' FROM (SELECT doc_id, s, lag(e) OVER (PARTITION BY doc_id ORDER BY s, e, type) AS pe FROM fb) GROUP BY doc_id HAVING count(*) FILTER (s < pe) > 3
        UNION ALL SELECT doc_id, NULL, 'missing document' FROM want WHERE doc_id NOT IN (SELECT doc_id FROM fb) UNION ALL SELECT DISTINCT doc_id, NULL, 'unexpected document' FROM fb WHERE doc_id NOT IN (SELECT doc_id FROM want)""",
        "base", "cmap", "docs", extra=_FAULTY,
    )
)
def hard_gate(spark, d):
    m = V.code_map(spark, d)
    s = C.assign_codes(V.base(spark, d).withColumnRenamed("base_ord", "ord"), m)
    coded = F.col("type").isin(*vocab.CODED_TYPES)
    s = s.withColumn("codes", F.when(~coded & (F.col("start") % 57 == 0), F.array(F.lit("1"))).otherwise(F.col("codes")))
    s = s.withColumn("type", F.when(F.col("start") % 50 == 0, F.lit("other")).otherwise(F.col("type"))).withColumn("text", F.when(F.col("start") % 53 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    s = s.withColumn("assertions", F.when(F.col("start") % 51 == 0, F.array(F.lit("isUncertain"))).otherwise(F.col("assertions")))
    known = m.filter("length(surface) % 2 = 0").select("type", F.explode("codes").alias("code"))
    return V.flat(R.violations(s, V.docs(spark, d), known, table(spark, d, "documents").filter("doc_id % 100 <> 0").select("doc_id")))


@query(V.sql("SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE text NOT LIKE '%|%') AS same FROM mention GROUP BY doc_id", "mention"))
def codec_roundtrip(spark, d):
    """Spans to lines and back; same counts rows that come back with text, type and labels unchanged.
    The codec does not escape its separator, so texts that hold one do not."""
    m = L.with_context(V.mentions(spark, d), V.docs(spark, d)).withColumn("before", F.col("left"))
    back = R.decode_lines(R.encode_lines(m)).withColumn("item_ord", F.col("item_ord") + 1)
    both = m.select("doc_id", "item_ord", "text", "type", F.array_sort("assertions").alias("assertions")).join(back.select("doc_id", "item_ord", F.col("text").alias("t2"), F.col("type").alias("y2"), F.col("assertions").alias("a2")), ["doc_id", "item_ord"], "left")
    same = (F.col("text") == F.col("t2")) & (F.col("type") == F.col("y2")) & (F.col("assertions") == F.col("a2"))
    return both.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(same).alias("same"))


@query("SELECT conv_id, to_json(list({'role': role, 'content': text} ORDER BY turn))::VARCHAR AS messages FROM conversations GROUP BY conv_id")
def train_messages(spark, d):
    return R.train_messages(table(spark, d, "conversations"))


@query("SELECT doc_id, CASE WHEN ((doc_id - 1) % 7 + 7) % 7 = 0 THEN 'dev' ELSE 'train' END AS split FROM documents")
def train_dev_split(spark, d):
    return R.modulus_split(table(spark, d, "documents").select("doc_id"), "doc_id")


_ENTRIES = [("ation", "A1"), ("the", "B2"), ("er", "C3"), ("o", "D4")]


@query(V.sql("SELECT doc_id, s AS \"start\", CASE " + " ".join(f"WHEN contains(lower(trim(text)), '{n}') THEN '{c}'" for n, c in _ENTRIES) + " END AS code FROM mention", "mention"))
def dictionary_label(spark, d):
    """The code of the first dictionary entry that a mention contains."""
    return V.flat(V.mentions(spark, d).select("doc_id", "start", K.first_dictionary_entry(F.col("text"), _ENTRIES).alias("code")))


_FORCE = {
    "idx": "SELECT DISTINCT lower(w) AS gram FROM tok WHERE regexp_matches(lower(w), '^[a-z]{6,8}$') AND length(w) % 2 = 0 AND w NOT LIKE '%er'",
    "fs": "SELECT doc_id, base_ord, type, CASE s % 4 WHEN 0 THEN text || ' 10 mg po' WHEN 1 THEN 'dị ứng ' || text WHEN 2 THEN text || ' 5 mg pain' ELSE text END AS text FROM base",
    "fh": "SELECT *, CASE WHEN regexp_extract(text, '^[A-Za-zÀ-ỹ][A-Za-zÀ-ỹ0-9''\\-]*', 0) = '' THEN NULL WHEN lower(regexp_extract(text, '^[A-Za-zÀ-ỹ][A-Za-zÀ-ỹ0-9''\\-]*', 0)) IN (SELECT gram FROM idx) THEN regexp_extract(text, '^[A-Za-zÀ-ỹ][A-Za-zÀ-ỹ0-9''\\-]*', 0) END AS head FROM fs",
}


@query(
    V.sql(
        f"""SELECT doc_id, base_ord, CASE WHEN type <> '{vocab.DRUG}' AND head IS NOT NULL AND NOT regexp_matches(lower(text), '{vocab.NO_DRUG}')
          AND len(list_filter(string_split_regex(substr(text, length(head) + 1), '\\s+'), lambda w: w <> '' AND NOT regexp_matches(lower(w), '{vocab.DRUG_TAIL}'))) = 0 THEN '{vocab.DRUG}' ELSE type END AS type FROM fh""",
        "base", "tok", extra=_FORCE,
    )
)
def force_drugs(spark, d):
    k = F.col("start") % 4
    text = F.when(k == 0, F.concat("text", F.lit(" 10 mg po"))).when(k == 1, F.concat(F.lit("dị ứng "), "text")).when(k == 2, F.concat("text", F.lit(" 5 mg pain"))).otherwise(F.col("text"))
    spans = V.base(spark, d).select("doc_id", "base_ord", "type", text.alias("text"))
    index = V.tokens(spark, d).filter("length(w) % 2 = 0 and w not like '%er'").select(F.lower("w").alias("gram")).filter(F.col("gram").rlike("^[a-z]{6,8}$")).distinct()
    return V.flat(K.force_drugs(spans, index).select("doc_id", "base_ord", "type"))


@query("SELECT doc_id, round(j / (1 + j), 6) AS needed FROM (SELECT doc_id, (quality + toxic) / 2.0 AS j FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)")
def break_even_points(spark, d):
    j = (F.col("quality") + F.col("toxic")) / 2.0
    return table(spark, d, "labels").filter("quality is not null and toxic is not null").select("doc_id", F.round(break_even(j), 6).alias("needed"))


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) WHERE r IN (SELECT floor(k * (SELECT count(*) FROM documents) / 30.0) FROM range(30) t(k))")
def stratified_sample(spark, d):
    return R.systematic_sample(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 30)


@query(
    V.sql(
        "SELECT doc_id, voter, n, median FROM n JOIN (SELECT doc_id, list_sort(list(n))[count(*) // 2 + 1] AS median FROM n GROUP BY doc_id) USING (doc_id) WHERE median >= 8 AND n * 2 < median",
        "votes", extra={"n": "SELECT doc_id, voter, count(*) AS n FROM votes WHERE NOT (voter = 'd' AND doc_id % 3 = 0 AND s % 3 <> 0) GROUP BY ALL"},
    )
)
def density_gate(spark, d):
    return R.density_gate(V.votes(spark, d).filter("not (voter = 'd' and doc_id % 3 = 0 and start % 3 <> 0)"))


@query(V.sql("SELECT v.voter, d.doc_id FROM documents d, (SELECT unnest(['a', 'b', 'c', 'd']) AS voter) v WHERE NOT EXISTS (SELECT 1 FROM votes x WHERE x.voter = v.voter AND x.doc_id = d.doc_id)", "votes"))
def missing_docs(spark, d):
    return R.missing_docs(V.votes(spark, d), table(spark, d, "documents").select("doc_id"))


_TOPK = """SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding, e.embedding), 6) DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 {0}) WHERE rank <= {1}"""


@query(_TOPK.format("", 5))
def dense_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.flat(Q.dense_topk(queries, e, 5).select("query_id", "vec_id", "rank"))


@query("SELECT count(*) * 10 AS n, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def ann_recall(spark, d):
    """Whether inverted lists over every row find nine tenths of the exact ten nearest or more, asking as many cells as other
    queries need for a little more than that."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    queries = [e.filter(F.col("vec_id") % 20 == m).select(F.col("vec_id").alias("query_id"), "embedding") for m in (0, 1)]
    centres = Q.fit_cells(e)
    lists = Q.inverted_lists(e, centres)
    found = Q.ann_topk(queries[0], lists, centres, 10, Q.probes_needed(queries[1], lists, centres, 10, 0.95))
    return Q.recall(found, Q.dense_topk(queries[0], e, 10)).select("n", (F.col("recall") >= 0.9).alias("reached"))


@query(
    "SELECT query_id, CASE WHEN s >= 0.5 THEN vec_id END AS vec_id FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding, e.embedding) AS s, row_number() OVER (PARTITION BY q.vec_id "
    "ORDER BY round(list_cosine_similarity(q.embedding, e.embedding), 6) DESC, e.vec_id) AS r FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id % 20 <> 0 AND e.label % 2 = 1) WHERE r = 1"
)
def dense_top1_filtered(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return Q.top1_with_threshold(queries, e.filter("label % 2 = 1 and vec_id % 20 <> 0").select("vec_id", "embedding"), 0.5).select("query_id", "vec_id")


@query(
    V.sql(
        "SELECT item_id AS term_id, doc_id, count(*) AS shared FROM (SELECT *, least(2, max(r) OVER (PARTITION BY item_id)) AS need FROM rr WHERE r <= 3) JOIN (SELECT DISTINCT doc_id, w FROM tok) USING (w) GROUP BY term_id, doc_id HAVING count(*) >= any_value(need)",
        "tok",
        extra={
            "bt": "SELECT DISTINCT item_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM benchmark",
            "df": "SELECT w, count(DISTINCT doc_id) AS df FROM tok GROUP BY w",
            "rr": "SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY df, w) AS r FROM bt JOIN df USING (w)",
        },
    )
)
def rare_token_match(spark, d):
    return Q.rare_token_match(*_terms_and_words(spark, d))


@query(
    V.sql(
        """SELECT doc_id, term_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term_id) AS k FROM sc) WHERE k = 1""",
        "tok",
        extra={
            "bl": "SELECT item_id * 1000 + generate_subscripts(string_split(text, chr(10)), 1) - 1 AS term_id, unnest(string_split(text, chr(10))) AS l FROM benchmark",
            "dl": "SELECT doc_id * 1000000 + generate_subscripts(string_split(text, chr(10)), 1) - 1 AS doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL",
            "bt": "SELECT DISTINCT term_id, w FROM (SELECT term_id, unnest(string_split(l, ' ')) AS w FROM bl) WHERE w <> ''",
            "dt": "SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split(l, ' ')) AS w FROM dl) WHERE w <> ''",
            "df": "SELECT w, count(*) AS df FROM dt GROUP BY w",
            "rr": "SELECT term_id, w, row_number() OVER (PARTITION BY term_id ORDER BY df, w) AS r FROM bt JOIN df USING (w)",
            "cand": "SELECT DISTINCT term_id, doc_id FROM rr JOIN dt USING (w) WHERE r <= 3",
            "sh": "SELECT term_id, doc_id, count(*) AS c FROM bt JOIN dt USING (w) GROUP BY ALL",
            "sc": """SELECT term_id, doc_id, c / (na + nb - c)::DOUBLE AS score FROM cand JOIN sh USING (term_id, doc_id) JOIN (SELECT term_id, count(*) AS na FROM bt GROUP BY term_id) USING (term_id)
              JOIN (SELECT doc_id, count(*) AS nb FROM dt GROUP BY doc_id) USING (doc_id) WHERE c / (na + nb - c)::DOUBLE >= 0.88 - 1e-9""",
        },
    )
)
def rare_token_best(spark, d):
    """For each line of the documents the line of the benchmark that it is most like."""

    def words(name, key, many):
        lines = table(spark, d, name).filter("text is not null").select(key, F.posexplode(F.split("text", "\n")).alias("n", "l"))
        return lines.select((F.col(key) * many + F.col("n")).alias("id"), F.explode(F.split("l", " ")).alias("w"))

    return Q.rare_token_best(words("benchmark", "item_id", 1000).withColumnRenamed("id", "term_id"), words("documents", "doc_id", 1_000_000).withColumnRenamed("id", "doc_id"))


def _terms_and_words(spark, d):
    terms = table(spark, d, "benchmark").select(F.col("item_id").alias("term_id"), F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    words = V.docs(spark, d).select("doc_id", F.explode(F.split("body", " ")).alias("w"))
    return terms, words


#: An invented ledger: a base run, single edits, a combination, one arithmetic slip, a decimal comma and a blank.
_LEDGER = [
    (0, "base", "37.22", "58.0", "48.0", "25.55"), (1, "prune_light", "37.46", "57.4", "48.2", "25.55"), (2, "prune_heavy", "37.10", "58.4", "48.0", "25.55"), (3, "augment", "38,12", "55.0", "48.0", "25.55"),
    (4, "slip", "39.00", "57.0", "48.0", "25.55"), (5, "all", "38.42", "54.2", "48.2", "25.55"), (6, "pending", "", "", "", ""),
]
_LEDGER_SQL = "(VALUES " + ", ".join("(" + ", ".join([str(r[0]), f"'{r[1]}'"] + [f"try_cast('{x.replace(',', '.')}' AS DOUBLE)" for x in r[2:]]) + ")" for r in _LEDGER) + ") l(stt, run, score, wer, j_assert, j_cand)"


def _ledger(spark):
    return R.ledger_numbers(spark.createDataFrame(_LEDGER, "stt int, run string, score string, wer string, j_assert string, j_cand string"))


@query(f"SELECT stt, run, score, abs(0.3 * (100 - wer) + 0.3 * j_assert + 0.4 * j_cand - score) > 0.01 AS mismatch FROM {_LEDGER_SQL}")
def ledger_check(spark, d):
    return V.flat(_ledger(spark).select("stt", "run", "score", "mismatch"))


@query(f"SELECT l.run, round(l.score - b.score, 6) AS delta, round((b.wer - l.wer) * 0.3, 6) AS by_wer, round((l.j_assert - b.j_assert) * 0.3, 6) AS by_assert, round((l.j_cand - b.j_cand) * 0.4, 6) AS by_cand FROM {_LEDGER_SQL}, (SELECT * FROM {_LEDGER_SQL} WHERE stt = 0) b WHERE l.score IS NOT NULL")
def ledger_delta(spark, d):
    return R.ledger_deltas(_ledger(spark), "base").select("run", *[(F.round(c, 6) + 0.0).alias(c) for c in ("delta", "by_wer", "by_assert", "by_cand")])


@query(f"SELECT run, best_before, coalesce(score > best_before, true) AS is_best FROM (SELECT *, max(score) OVER (ORDER BY stt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM {_LEDGER_SQL} WHERE score IS NOT NULL)")
def ledger_best(spark, d):
    return R.ledger_best(_ledger(spark)).select("run", "best_before", "is_best")


@query("SELECT * FROM (VALUES ('prune_light', 'prune_heavy', 'between'), ('prune_light', 'augment', 'raise')) t(light, heavy, verdict)")
def ledger_dose(spark, d):
    pairs = spark.createDataFrame([("prune_light", "prune_heavy"), ("prune_light", "augment")], "light string, heavy string")
    return R.dose_verdict(R.ledger_deltas(_ledger(spark), "base"), pairs).select("light", "heavy", "verdict")


@query("SELECT 1.14 AS parts_sum, 1.2 AS whole, true AS additive")
def ledger_additivity(spark, d):
    return R.additivity(R.ledger_deltas(_ledger(spark), "base"), ["prune_light", "augment"], "all").select(F.round("parts_sum", 6).alias("parts_sum"), F.round("whole", 6).alias("whole"), "additive")
