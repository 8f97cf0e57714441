"""Queries on document structure and text location."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions.text import nfd
from spanloom.operators import locate as L
from spanloom.operators import structure as S
from spanloom.plans import views as V
from spanloom.plans.registry import query
from spanloom.sources.tables import table


@query("SELECT lang, source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, max(length(text)) AS longest, sum(length(text) - length(replace(text, ' ', '')))::BIGINT AS n_blanks FROM documents GROUP BY ALL")
def scan_docs_profile(spark, d):
    blanks = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    t = table(spark, d, "documents").groupBy("lang", "source")
    return t.agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.max(F.length("text")).cast("long").alias("longest"), F.sum(blanks).alias("n_blanks"))


_LINES = {
    "ln0": "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents",
    "ln": "SELECT doc_id, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM ln0",
}


@query(V.sql('SELECT doc_id, line_no::BIGINT AS line_no, s AS "start", length(line) AS len, true AS verbatim FROM ln', extra=_LINES))
def lines_with_offsets(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    lines = S.split_lines(docs)
    slices = docs.join(lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "start", "line"))).alias("l")), "doc_id")
    ok = slices.select("doc_id", "text", F.explode("l").alias("x")).select("doc_id", "x.*", (F.substring(F.col("text"), F.col("x.start") + 1, F.length("x.line")) == F.col("x.line")).alias("verbatim"))
    return ok.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("start").cast("long").alias("start"), F.length("line").cast("long").alias("len"), "verbatim")


_HEADER = "line LIKE '%.' AND len(string_split(line, ' ')) <= 4"


@query(V.sql(f"SELECT doc_id, line_no::BIGINT AS line_no, last_value(CASE WHEN {_HEADER} THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM ln", extra=_LINES))
def lines_section_ffill(spark, d):
    lines = S.split_lines(table(spark, d, "documents").select("doc_id", "text"))
    header = F.endswith("line", F.lit(".")) & (F.size(F.split("line", " ")) <= 4)
    return S.forward_fill(lines, "doc_id", "line_no", header, F.col("line"), "section").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "section")


_SECTION, _BULLET, _LABELLED = r"^\s*(\d)\.\s+(.{3,60}?)\s*$", r"^\s*[-–•*]\s*(.*)$", r"^\s*([^:\-–•*][^:]{2,55}):\s*(.*)$"


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def parsed_sql(docs: str) -> dict[str, str]:
    """CTE ``pl``: the content lines of ``docs`` (doc_id, text) with their section and label."""
    one = "translate(text, concat(" + ", ".join(f"chr({ord(c)})" for c in S.BREAKS) + "), repeat(chr(10), " + str(len(S.BREAKS)) + "))"
    below = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)"
    return {
        "pl0": f"SELECT doc_id, unnest(string_split({one}, chr(10))) AS line, generate_subscripts(string_split({one}, chr(10)), 1) - 1 AS line_no FROM {docs}",
        "pl1": "SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM pl0",
        "pl2": rf"""SELECT *, CASE WHEN regexp_matches(line, '{_SECTION}') THEN 'section' WHEN regexp_matches(line, '{_BULLET}') THEN 'bullet' WHEN regexp_matches(line, '{_LABELLED}') THEN 'value'
          WHEN length(trim(line)) <= 60 AND NOT regexp_matches(line, '\d') AND len(list_filter([{_listed(vocab.SUBHEADER_PREFIXES)}], lambda p: starts_with(lower(trim(line)), p))) > 0 THEN 'label' ELSE 'plain' END AS kind
          FROM pl1 WHERE regexp_matches(line, '\S')""",
        "pl3": rf"""SELECT *, CASE kind WHEN 'bullet' THEN regexp_extract(line, '{_BULLET}', 1) WHEN 'value' THEN regexp_extract(line, '{_LABELLED}', 2) ELSE regexp_replace(line, '^\s+', '') END AS body,
          last_value(CASE WHEN kind = 'section' THEN lower(trim(regexp_extract(line, '{_SECTION}', 2))) END IGNORE NULLS) {below} AS sec,
          last_value(CASE kind WHEN 'value' THEN lower(trim(regexp_extract(line, '{_LABELLED}', 1))) WHEN 'label' THEN lower(trim(line)) WHEN 'section' THEN '' END IGNORE NULLS) {below} AS lab FROM pl2""",
        "pl": rf"""SELECT doc_id, line_no, s + length(line) - length(body) AS s, regexp_replace(body, '\s+$', '') AS text, coalesce(sec, '') AS section, coalesce(lab, '') AS sub, kind,
          coalesce(sec, '') IN ({_listed(vocab.HISTORY_SECTIONS)}) OR coalesce(lab, '') IN ({_listed(vocab.HISTORICAL_SUBS)}) AS historical, coalesce(lab, '') IN ({_listed(vocab.SKIPPED_SUBS)}) AS skip
          FROM pl3 WHERE kind IN ('bullet', 'value', 'plain') AND regexp_replace(body, '\s+$', '') <> ''""",
    }


#: Documents whose lines take the shapes of notes: by their number, sections, bullets, labels with and without a value.
_NOTE_HEADS = {0: "1. tiền sử bệnh", 1: "- ", 2: "bệnh lý mãn tính: ", 3: "kết quả xét nghiệm", 5: "2. Bệnh sử", 7: "Vị trí:"}
_NOTES = {
    "nl": "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL",
    "notes": "SELECT doc_id, string_agg(CASE (doc_id + line_no * 3) % 11 " + " ".join(f"WHEN {k} THEN '{v}' || {chr(39) * 2 if not v.endswith(' ') else 'line'}" for k, v in _NOTE_HEADS.items()) + " ELSE line END, chr(10) ORDER BY line_no) AS text FROM nl GROUP BY doc_id",
}


def notes(spark, d):
    """doc_id, text of the notes."""
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.split("text", "\n").alias("l"))

    def shaped(line, no):
        k = (F.col("doc_id") + no * 3) % 11
        out = None
        for n, head in _NOTE_HEADS.items():
            value = F.concat(F.lit(head), line) if head.endswith(" ") else F.lit(head)
            out = F.when(k == n, value) if out is None else out.when(k == n, value)
        return out.otherwise(line)

    return lines.select("doc_id", F.array_join(F.transform("l", shaped), "\n").alias("text"))


@query(V.sql('SELECT doc_id, line_no::BIGINT AS line_no, s AS "start", s + length(text) AS "end", text, section, sub, kind, historical, skip FROM pl', extra=_NOTES | parsed_sql("notes")))
def parsed_lines(spark, d):
    return V.flat(S.parse_lines(notes(spark, d)))


@query(
    V.sql(
        "SELECT m.doc_id, m.s AS \"start\", m.text, (SELECT arg_max(label, pos) FROM h WHERE h.doc_id = m.doc_id AND h.pos < m.s) AS section FROM mention m",
        "mention", extra={"h": "SELECT doc_id, s AS pos, w AS label FROM tok WHERE w LIKE '%.' AND length(w) >= 4"},
    )
)
def section_asof(spark, d):
    headers = V.tokens(spark, d).filter("w like '%.' and length(w) >= 4").select("doc_id", F.col("start").alias("pos"), F.col("w").alias("label"))
    return V.flat(S.section_at(V.mentions(spark, d).select("doc_id", "start", "text"), headers, F.length("label")))


@query(
    V.sql(
        'SELECT doc_id, line_no::BIGINT AS line_no, s AS "start" FROM ln l WHERE trim(line) <> \'\' AND len(list_filter(string_split(line, \' \'), lambda x: x <> \'\')) <= 6 AND NOT EXISTS (SELECT 1 FROM mention m WHERE m.doc_id = l.doc_id AND m.s < l.s + length(line) AND m.e > l.s)',
        "mention", extra=_LINES,
    )
)
def short_line_filter(spark, d):
    lines = S.split_lines(table(spark, d, "documents").select("doc_id", "text")).filter("trim(line) <> ''")
    lines = lines.select("doc_id", "line_no", "start", (F.col("start") + F.length("line")).alias("end"), F.col("line").alias("text"))
    kept = S.short_lines(lines, V.mentions(spark, d).select("doc_id", "start", "end"))
    return V.flat(kept.select("doc_id", "line_no", "start"))


@query("""SELECT doc_id, count(*) AS n, sum(len)::BIGINT AS chars FROM (SELECT doc_id, length(unnest(regexp_extract_all(text, '\\*{3,}'))) AS len FROM documents) GROUP BY doc_id""")
def mask_runs(spark, d):
    runs = S.mask_runs(table(spark, d, "documents").select("doc_id", "text"))
    return runs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("mask_len").alias("chars"))


_CTX = {"ctx": "SELECT m.*, substr(body, greatest(s - 15, 0) + 1, least(15, s)::BIGINT) AS bef, substr(body, e + 1, 15) AS aft FROM mention m JOIN docs USING (doc_id)"}


@query(V.sql('SELECT doc_id, s AS "start", bef AS before, text, aft AS after FROM ctx', "mention", extra=_CTX))
def context_slice(spark, d):
    m = L.with_context(V.mentions(spark, d).select("doc_id", "start", "end", "text"), V.docs(spark, d))
    return V.flat(m.select("doc_id", "start", F.col("left").alias("before"), "text", F.col("right").alias("after")))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS ok FROM events""")
def tolerant_json(spark, d):
    from spanloom.sources.readers import tolerant_object

    e = table(spark, d, "events").withColumn("o", tolerant_object(F.col("props"), "k string"))
    return e.select("event_id", F.col("o.k").try_cast("bigint").alias("k"), F.col("o").isNotNull().alias("ok"))


def hits_sql(need: str, name: str = "pos", docs: str = "docs") -> dict[str, str]:
    """CTE ``name`` (doc_id, text, p): every place, overlapping ones included, of the distinct texts of ``need``; a step of the
    recursion finds the next place of each."""
    return {
        f"need_{name}": need,
        name: f"""SELECT doc_id, text, instr(body, text)::BIGINT - 1 AS p FROM need_{name} JOIN {docs} USING (doc_id) WHERE instr(body, text) > 0
          UNION ALL SELECT h.doc_id, h.text, h.p + instr(substr(body, h.p + 2), h.text) FROM {name} h JOIN {docs} d ON d.doc_id = h.doc_id WHERE instr(substr(body, h.p + 2), h.text) > 0""",
    }


@query(
    V.sql(
        "SELECT doc_id, text, count(*) AS n, min(p)::BIGINT AS first, max(p)::BIGINT AS last FROM pos GROUP BY ALL",
        "mention", "docs", extra=hits_sql("SELECT DISTINCT doc_id, text FROM mention"),
    )
)
def locate_all(spark, d):
    return _located(spark, d, V.mentions(spark, d))


def _located(spark, d, mentions):
    need = mentions.select("doc_id", "text").distinct()
    hits = L.occurrences(need, V.docs(spark, d), nfc_fallback=False)
    return hits.groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first"), F.max("start").cast("long").alias("last"))


def _requests(spark, d):
    """All votes as requests with the context that a voter would quote: now and then off by a character, or short."""
    m = L.with_context(V.votes(spark, d), V.docs(spark, d))
    k = F.col("start") % 5
    before = F.when(k == 0, F.expr("right(left, 6)")).when(k == 1, F.concat(F.lit("x"), "left")).otherwise(F.col("left"))
    after = F.when(k == 1, F.expr("left(right, 6)")).when(k == 2, F.lit("")).otherwise(F.col("right"))
    return m.select("doc_id", "voter", "item_ord", "text", "type", "assertions", before.alias("before"), after.alias("after"))


_REQ = {
    "vc": "SELECT v.*, substr(body, greatest(s - 15, 0) + 1, least(15, s)::BIGINT) AS l, substr(body, e + 1, 15) AS r FROM votes v JOIN docs USING (doc_id)",
    "req": "SELECT doc_id, voter, item_ord, text, type, CASE s % 5 WHEN 0 THEN right(l, 6) WHEN 1 THEN 'x' || l ELSE l END AS bef, CASE s % 5 WHEN 1 THEN left(r, 6) WHEN 2 THEN '' ELSE r END AS aft FROM vc",
} | hits_sql("SELECT DISTINCT doc_id, text FROM req") | {
    "hit": "SELECT doc_id, text, p, substr(body, greatest(p - 15, 0) + 1, least(15, p)) AS l, substr(body, p + length(text) + 1, 15) AS r FROM pos JOIN docs USING (doc_id)",
}
_G = "doc_id, voter, text, type, bef, aft"


@query(
    V.sql(
        """SELECT r.doc_id, r.voter, r.item_ord, CASE WHEN b.best IS NULL THEN NULL ELSE p END AS "start",
          CASE WHEN b.best IS NULL THEN 'context' WHEN p IS NULL THEN 'surplus' WHEN nk > 1 THEN 'ordinal' ELSE 'accepted' END AS reason
        FROM rn r JOIN (SELECT DISTINCT doc_id, voter, text, type, bef, aft, best FROM lv) b USING (doc_id, voter, text, type, bef, aft)
        LEFT JOIN kp k ON k.doc_id = r.doc_id AND k.voter = r.voter AND k.text = r.text AND k.type = r.type AND k.bef = r.bef AND k.aft = r.aft AND k.nth = r.nth""",
        "votes",
        extra=_REQ | {
            "rn": f"SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY item_ord) AS nth FROM req",
            "lv0": f"""SELECT q.*, h.p, h.l, h.r, count(*) OVER (PARTITION BY {_G}) AS nh FROM (SELECT DISTINCT {_G} FROM req) q JOIN hit h USING (doc_id, text)""",
            "lv1": """SELECT *, CASE WHEN nh = 1 THEN 0 WHEN (bef = '' OR suffix(l, bef)) AND (aft = '' OR starts_with(r, aft)) THEN 0 WHEN bef <> '' AND suffix(l, bef) THEN 1 WHEN aft <> '' AND starts_with(r, aft) THEN 2
              WHEN (bef <> '' OR aft <> '') AND (bef = '' OR suffix(l, right(bef, 6))) AND (aft = '' OR starts_with(r, left(aft, 6))) THEN 3 WHEN bef <> '' AND suffix(l, right(bef, 4)) THEN 4 END AS lvl FROM lv0""",
            "lv": f"SELECT *, min(lvl) OVER (PARTITION BY {_G}) AS best FROM lv1",
            "kp": f"SELECT *, count(*) OVER (PARTITION BY {_G}) AS nk, row_number() OVER (PARTITION BY {_G} ORDER BY p) AS nth FROM lv WHERE lvl = best",
        },
    )
)
def locate_group_ordinal(spark, d):
    out = L.locate_group(_requests(spark, d), V.docs(spark, d), nfc_fallback=False)
    return V.flat(out.select("doc_id", "voter", "item_ord", "start", "reason"))


@query(
    V.sql(
        """SELECT doc_id, voter, item_ord, CASE WHEN nh = 1 THEN p1 WHEN n0 = 1 THEN p0 WHEN n0 > 1 THEN NULL WHEN nb = 1 THEN pb WHEN na = 1 THEN pa END AS "start", nh AS n_hits,
          CASE WHEN nh = 1 OR n0 = 1 OR (n0 = 0 AND (nb = 1 OR na = 1)) THEN 'accepted' WHEN n0 > 1 THEN 'ambiguous' ELSE 'context' END AS reason FROM (
          SELECT doc_id, voter, item_ord, count(*) AS nh, min(p) AS p1, count(*) FILTER (c0) AS n0, min(p) FILTER (c0) AS p0, count(*) FILTER (cb) AS nb, min(p) FILTER (cb) AS pb, count(*) FILTER (ca) AS na, min(p) FILTER (ca) AS pa FROM (
            SELECT q.*, h.p, (bef = '' OR suffix(l, bef)) AND (aft = '' OR starts_with(r, aft)) AS c0, bef <> '' AND suffix(l, bef) AS cb, aft <> '' AND starts_with(r, aft) AS ca FROM req q JOIN hit h USING (doc_id, text)) GROUP BY ALL)""",
        "votes", extra=_REQ,
    )
)
def locate_strict_reasons(spark, d):
    out = L.locate_strict(_requests(spark, d), V.docs(spark, d), nfc_fallback=False)
    return V.flat(out.select("doc_id", "voter", "item_ord", "start", "n_hits", "reason"))


@query(V.sql("SELECT doc_id, text, count(*) AS n FROM pos GROUP BY ALL", "mention", "docs", extra=hits_sql("SELECT DISTINCT doc_id, text FROM mention WHERE strlen(text) > length(text)")))
def locate_nfc_fallback(spark, d):
    """Needles are taken apart (NFD), so that only the fallback finds them; the composed form's count is the truth."""
    return _located_nfc(spark, d, V.mentions(spark, d))


def _located_nfc(spark, d, mentions):
    need = mentions.filter("octet_length(text) > length(text)").select("doc_id", "text").distinct()
    need = need.withColumn("composed", F.col("text")).withColumn("text", nfd(F.col("text")))
    hits = L.occurrences(need, V.docs(spark, d))
    return hits.join(need, ["doc_id", "text"]).groupBy("doc_id", F.col("composed").alias("text")).agg(F.count("*").alias("n"))


@query(
    V.sql(
        "SELECT voter, type, count(*) AS n, count(*) FILTER (WHERE instr(body, bef || text) > 0 OR instr(body, text) > 0) AS found, count(*) FILTER (WHERE bef <> '' AND instr(body, bef || text) > 0) AS led FROM req JOIN docs USING (doc_id) GROUP BY voter, type",
        "votes", "docs", extra={k: _REQ[k] for k in ("vc", "req")},
    )
)
def locate_rate(spark, d):
    v = L.first_places(_requests(spark, d), V.docs(spark, d))
    return v.groupBy("voter", "type").agg(F.count("*").alias("n"), F.count("start").alias("found"), F.count_if("led").alias("led"))


@query(V.sql("SELECT doc_id, count(*) AS concepts, sum(len(string_split(text, ' ')))::BIGINT AS words, round(sum(len(string_split(text, ' '))) / count(*)::DOUBLE, 6) AS words_each FROM base GROUP BY doc_id", "base"))
def concept_density(spark, d):
    n = F.size(F.split("text", " "))
    return V.base(spark, d).groupBy("doc_id").agg(F.count("*").alias("concepts"), F.sum(n).alias("words"), F.round(F.sum(n) / F.count("*"), 6).alias("words_each"))


@query()
def roundtrip(spark, d):
    """Spans become requests with 15 characters of context and are located again.  Passages that repeat word for word may
    come back in another of their places."""
    m = L.with_context(V.mentions(spark, d), V.docs(spark, d)).withColumn("voter", F.lit("a"))
    req = m.select("doc_id", "voter", "item_ord", "text", "type", "assertions", F.col("left").alias("before"), F.col("right").alias("after"))
    got = L.locate_group(req, V.docs(spark, d), nfc_fallback=False)
    both = got.join(V.mentions(spark, d).select("doc_id", "item_ord", F.col("start").alias("want")), ["doc_id", "item_ord"])
    return both.agg(F.count("*").alias("n"), F.count("start").alias("accepted"), F.count_if(F.coalesce(F.col("start") == F.col("want"), F.lit(False))).alias("right_place"))
