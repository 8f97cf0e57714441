"""Queries that write sets, votes, reviews and terminologies in their file forms and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import locate as L
from spanloom.operators import records as R
from spanloom.plans import views as V
from spanloom.plans.edit_queries import _SETS, _gold
from spanloom.plans.record_queries import _LEDGER, _LEDGER_SQL
from spanloom.plans.registry import ORACLE_SQL, query
from spanloom.sources import readers, writers
from spanloom.sources.shared import keep, new_path
from spanloom.sources.tables import table
from spanloom.streaming import votes as stream

_GA = {"ga": _SETS["ga"]}
_SPANS_SQL = V.sql(
    """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s, e, text, type) - 1)::BIGINT AS ord, text, type, codes, asr AS assertions, s AS "start", e AS "end" FROM ga""", "base", "cmap", extra=_GA
)


@query(_SPANS_SQL)
def annotation_folder(spark, d):
    """A set written as JSON lines and read back."""
    path = new_path(spark, "set")
    writers.write_annotation_folder(_gold(spark, d), path)
    return V.flat(readers.read_annotation_lines(spark, path))


@query(_SPANS_SQL)
def annotation_archive(spark, d):
    """A set packed into archives of one file for each document and unpacked."""
    path = new_path(spark, "archives")
    writers.archives(_gold(spark, d), 200).write.parquet(path)
    return V.flat(readers.unpack(spark.read.parquet(path)))


@query(V.sql("SELECT doc_id, voter, (row_number() OVER (PARTITION BY doc_id, voter ORDER BY item_ord) - 1)::BIGINT AS item_ord, text, type, asr AS assertions, substr(body, greatest(s - 15, 0) + 1, least(15, s)::BIGINT) AS before, substr(body, e + 1, 15) AS after FROM votes JOIN docs USING (doc_id)", "votes", "docs"))
def vote_files(spark, d):
    """Votes written as files that map documents to votes, and read back."""
    path = new_path(spark, "votes")
    v = L.with_context(V.votes(spark, d), V.docs(spark, d))
    writers.write_vote_files(v.withColumnRenamed("left", "before").withColumnRenamed("right", "after"), path)
    return V.flat(readers.read_votes(spark, path))


@query(V.sql("SELECT doc_id, s AS \"start\", e AS \"end\", type, text, replace(asr, '|', ';') AS assertions, substr(body, greatest(s - 35, 0) + 1, least(35, s)::BIGINT) || '【' || text || '】' || substr(body, e + 1, 35) AS context FROM base JOIN docs USING (doc_id)", "base", "docs"))
def review_csv(spark, d):
    path = new_path(spark, "review")
    writers.write_review(V.base(spark, d), V.docs(spark, d), path)
    back = readers.read_reviews(spark, path, "doc_id bigint, start bigint, end bigint, type string, text string, assertions string, context string")
    return back.withColumn("assertions", F.coalesce("assertions", F.lit("")))


@query("SELECT conv_id, to_json(list({'role': role, 'content': text} ORDER BY turn))::VARCHAR AS messages, CASE WHEN (conv_id - 1) % 7 = 0 THEN 'dev' ELSE 'train' END AS split FROM conversations GROUP BY conv_id")
def sample_files(spark, d):
    path = new_path(spark, "samples")
    writers.write_samples(R.modulus_split(R.train_messages(table(spark, d, "conversations")), "conv_id"), path)
    return spark.read.schema("conv_id bigint, messages string, split string").json(path)


@query("SELECT doc_id::VARCHAR AS file, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang ELSE '' END AS output FROM documents")
def prediction_lines(spark, d):
    path = new_path(spark, "predictions")
    k = F.col("doc_id") % 3
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.when(k == 0, F.col("source")).alias("output"), F.when(k == 1, F.col("lang")).alias("text"))
    rows.write.json(path)
    return readers.read_predictions(spark, path)


_CODES = "SELECT p_partkey, 'C' || lpad((p_partkey % 700)::VARCHAR, 4, '0') AS code, lower(p_type) AS descr FROM part"


@query(f"SELECT 'code' AS kind, arg_min(code, p_partkey) AS code, descr FROM ({_CODES}) GROUP BY descr UNION ALL SELECT 'descr', code, arg_max(descr, p_partkey) FROM ({_CODES}) GROUP BY code")
def fixed_width_codes(spark, d):
    """Codes in columns one to eight and descriptions after them: the first code of a description, the last description of a code."""
    path = new_path(spark, "codes")
    code = F.concat(F.lit("C"), F.lpad((F.col("p_partkey") % 700).cast("string"), 4, "0"))
    lines = table(spark, d, "part").repartitionByRange("p_partkey").sortWithinPartitions("p_partkey")
    lines.select(F.concat(F.rpad(code, 8, " "), F.lower("p_type")).alias("value")).write.text(path)
    codes = readers.read_fixed_width_codes(spark, path)
    first, last = readers.code_by_description(codes), readers.description_by_code(codes)
    return first.select(F.lit("code").alias("kind"), "code", "descr").unionByName(last.select(F.lit("descr").alias("kind"), "code", "descr"))


@query("SELECT p_partkey::VARCHAR AS rxcui, p_name AS name FROM part")
def concept_names(spark, d):
    path = new_path(spark, "concepts")
    item = F.struct(F.col("p_partkey").cast("string").alias("rxcui"), F.col("p_name").alias("name"))
    groups = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 500).alias("g")).agg(F.collect_list(item).alias("minConcept"))
    groups.select(F.to_json(F.struct(F.struct("minConcept").alias("minConceptGroup"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_concept_names(spark, path)


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 0 ELSE 2 END AS n, CASE WHEN turn % 3 = 2 THEN NULL ELSE conv_id END AS first FROM conversations")
def tolerant_arrays(spark, d):
    """Arrays in answers with chatter and fences around them, or broken."""
    body = F.concat(F.lit("["), F.col("conv_id").cast("string"), F.lit(", "), F.col("turn").cast("string"), F.when(F.col("turn") % 3 != 2, "]").otherwise(","))
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    a = table(spark, d, "conversations").withColumn("a", readers.tolerant_array(said, "bigint"))
    return a.select("conv_id", "turn", F.size("a").cast("long").alias("n"), F.get("a", F.lit(0)).alias("first"))


@query(V.sql("SELECT surface, type, codes FROM cmap", "cmap"))
def code_map_sink(spark, d):
    path = new_path(spark, "code-map")
    writers.write_code_map(V.code_map(spark, d), path)
    return V.flat(spark.read.parquet(path))


@query(V.sql("SELECT text, type, n, row_number() OVER (PARTITION BY type ORDER BY n DESC, text) AS rank FROM (SELECT lower(trim(text)) AS text, type, count(*) AS n FROM ga WHERE codes = '' AND type IN ('THUỐC', 'CHẨN_ĐOÁN') GROUP BY ALL)", "base", "cmap", extra=_GA))
def worklist_ranked(spark, d):
    return V.flat(writers.worklist(_gold(spark, d)))


@query(f"SELECT stt, run, CASE WHEN run = 'slip' THEN 38.5 ELSE score END AS score, wer FROM {_LEDGER_SQL} UNION ALL SELECT 7, 'late', 40.0, 50.0")
def ledger_write(spark, d):
    """One run's score mended, a new run added once."""
    ledger = R.ledger_numbers(spark.createDataFrame(_LEDGER, "stt int, run string, score string, wer string, j_assert string, j_cand string")).select("stt", "run", "score", "wer")
    mended = writers.upsert_ledger(ledger, spark.createDataFrame([("sl", 38.5)], "prefix string, score double"))
    late = spark.createDataFrame([(7, "late", 40.0, 50.0), (8, "base", 1.0, 1.0)], "stt int, run string, score double, wer double")
    return V.flat(writers.append_ledger(mended, late))


@query(V.sql("SELECT voter, doc_id, s AS \"start\", e AS \"end\", type, text FROM (SELECT DISTINCT voter, doc_id, s, e, type, text FROM votes)", "votes"))
def stream_votes(spark, d):
    """Votes that arrive twice, as a stream: each is kept once within the watermark."""
    source, sink = new_path(spark, "stream-in"), new_path(spark, "stream-out")
    v = V.votes(spark, d).select("voter", "voter_ord", "doc_id", "item_ord", "start", "end", "text", "type", "assertions", F.lit("2024-01-01T00:00:00").cast("timestamp").alias("at"))
    for _ in range(2):
        stream.write_votes(v, source)
    seen = stream.vote_stream(spark, source).select("voter", "doc_id", "start", "end", "type", "text")
    stream.run_stream(seen, sink, new_path(spark, "stream-state"))
    return V.flat(spark.read.parquet(sink))


@query(V.sql("SELECT voter, count(*) AS n FROM (SELECT DISTINCT voter, doc_id, s, e, type FROM votes) GROUP BY voter", "votes"))
def stream_counts(spark, d):
    """Votes by voter and ten-minute window of the same stream; all of them fall into one window."""
    source, sink = new_path(spark, "stream-in"), new_path(spark, "stream-out")
    v = V.votes(spark, d).select("voter", "voter_ord", "doc_id", "item_ord", "start", "end", "text", "type", "assertions", F.lit("2024-01-01T00:00:00").cast("timestamp").alias("at"))
    stream.write_votes(v, source)
    # a last vote, a day later, moves the watermark past the window
    stream.write_votes(v.limit(1).withColumn("voter", F.lit("end")).withColumn("at", F.lit("2024-01-02T00:00:00").cast("timestamp")), source)
    stream.run_stream(stream.counts_by_window(stream.vote_stream(spark, source)), sink, new_path(spark, "stream-state"))
    return spark.read.parquet(sink).select("voter", "n")


_HOUR = "timestamp_seconds(1704067200 + (doc_id % 3) * 3600)"


def _timed_votes(spark, d):
    """Votes of three rounds, an hour apart; every eleventh arrives hours late."""
    v = V.votes(spark, d).select("voter", "voter_ord", "doc_id", "item_ord", "start", "end", "text", "type", "assertions", F.expr(_HOUR).alias("at"))
    late = (F.col("start") + F.col("voter_ord") * 5) % 11 == 0
    return v.withColumn("arrived", F.col("at") + F.when(late, F.expr("interval 5 hours")).otherwise(F.expr("interval 20 minutes")))


def _streamed(spark, d, stream_of):
    """What a stream over files of the three rounds, the late votes and a last vote a day later gives."""
    source, sink = new_path(spark, "stream-in"), new_path(spark, "stream-out")
    votes = keep(_timed_votes(spark, d))
    in_time, late = stream.split_late(votes)
    rounds = [in_time.filter(F.col("doc_id") % 3 == r) for r in range(3)]
    end = F.lit("2024-01-02T12:00:00").cast("timestamp")
    last = spark.range(1).select(F.lit("end").alias("voter"), *[F.lit(0).cast(t).alias(c) for c, t in (("voter_ord", "int"), ("doc_id", "long"), ("item_ord", "int"), ("start", "int"), ("end", "int"))], F.lit("").alias("text"), F.lit("").alias("type"), F.array().cast("array<string>").alias("assertions"), end.alias("at"), end.alias("arrived"))
    for part in (*rounds, late, last):
        stream.write_votes(part.coalesce(4), source)
    stream.run_stream(stream_of(spark.readStream.schema(stream.ARRIVED).option("maxFilesPerTrigger", 4).json(source)), sink, new_path(spark, "stream-state"))
    return spark.read.parquet(sink)


def _in_time_sql(sql: str) -> str:
    return sql.replace("(doc_id * 31 + s * 7 + v * 13) % 10 < 7", "(doc_id * 31 + s * 7 + v * 13) % 10 < 7 AND (s + v * 5) % 11 <> 0")


@query(_in_time_sql(ORACLE_SQL["consensus_k2"]))
def stream_consensus(spark, d):
    """The consensus of two voters over votes in time, merged while they arrive in three rounds."""
    merged = _streamed(spark, d, lambda v: stream.consensus_stream(stream.split_late(v)[0], 2)).filter("kind = 'final'")
    return V.flat(merged.select("doc_id", "start", "end", "type", "text", "n_votes", "assertions"))


@query(V.sql("SELECT voter, count(*) AS n FROM votes WHERE (s + voter_ord * 5) % 11 = 0 GROUP BY voter", "votes"))
def stream_late_votes(spark, d):
    """Late votes of the same stream, counted apart."""
    return _streamed(spark, d, lambda v: stream.split_late(v)[1]).groupBy("voter").agg(F.count("*").alias("n"))


@query(V.sql("SELECT DISTINCT voter, doc_id FROM votes v WHERE NOT EXISTS (SELECT 1 FROM votes x WHERE x.voter = v.voter AND x.doc_id = v.doc_id AND (x.s % 3 = 0 AND x.voter <> 'b'))", "votes"))
def resumed_work(spark, d):
    """What of the work on each voter's documents is left after some of it was done."""
    v = V.votes(spark, d)
    return readers.resume(v.select("voter", "doc_id").distinct(), v.filter("start % 3 = 0 and voter <> 'b'"), ["voter", "doc_id"])


@query(
    V.sql(
        "SELECT voter, doc_id, CASE WHEN doc_id % 100 >= 50 OR odd = 0 THEN n ELSE odd END AS items, CASE WHEN odd > 0 THEN 2 ELSE 1 END AS n_parts FROM (SELECT voter, doc_id, count(*) AS n, count(*) FILTER (item_ord % 2 = 1) AS odd FROM votes GROUP BY ALL)",
        "votes",
    )
)
def merged_parts(spark, d):
    """Parts of a voter's answers that overlap by half: of two that have a document the first counts."""
    v = V.votes(spark, d).withColumn("v", F.struct("text", "type", "assertions", F.lit("").alias("before"), F.lit("").alias("after")))

    def parts(rows, low):
        items = rows.withColumn("low", low.cast("int")).groupBy("voter", "low", "doc_id").agg(F.collect_list("v").alias("items"))
        return items.groupBy("voter", "low").agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), "items"))).alias("parsed")).withColumn("ok", F.lit(True))

    whole, odd = parts(v, F.floor(F.col("doc_id") / 100) * 100), parts(v.filter("item_ord % 2 = 1"), F.floor((F.col("doc_id") + 50) / 100) * 100 - 50)
    broken = whole.withColumn("low", F.lit(-1000)).withColumn("ok", F.lit(False))
    merged = readers.merge_parts(whole.unionByName(odd).unionByName(broken))
    return V.flat(merged.select("voter", "doc_id", F.size("items").alias("items"), "n_parts"))


@query(_SPANS_SQL)
def gated_set(spark, d):
    """A set that breaks no rule, written through the gate and read back; one that does is refused."""
    path, spans = new_path(spark, "gated"), _gold(spark, d)
    broken = spans.filter("end <= start").select(F.lit("bounds").alias("rule"), "doc_id", "ord")
    writers.write_gated(spans, broken, path)
    try:
        writers.write_gated(spans, spans.limit(1).select(F.lit("any").alias("rule"), "doc_id", "ord"), new_path(spark, "refused"))
    except ValueError:
        return V.flat(readers.read_annotation_lines(spark, path))
    raise AssertionError("a set that breaks a rule was written")
