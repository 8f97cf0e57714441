"""Runs of voters on what changed, codes by prefix and index, the stateful consensus."""

import random

import numpy as np
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.operators import linking as K
from spanloom.operators import runs
from spanloom.operators import search as Q
from spanloom.streaming import votes as stream

DOCS = "doc_id long, body string"


def test_a_second_run_asks_for_changed_documents_alone(spark, tmp_path):
    asked = []

    def voter(name, ord_):
        def vote(docs):
            rows = docs.collect()
            asked.append((name, sorted(r.doc_id for r in rows)))
            out = [(r.doc_id, ord_, 1, 0, len(r.body), r.body, vocab.DRUG, ["isNegated"]) for r in rows if r.body]
            return docs.sparkSession.createDataFrame(out, "doc_id long, voter_ord int, item_ord int, start int, end int, text string, type string, assertions array<string>")

        return vote

    voters, store = {"a": voter("a", 0), "b": voter("b", 1)}, f"file://{tmp_path}/store"
    first = spark.createDataFrame([(1, "one"), (2, "two"), (3, ""), (4, "four")], DOCS)
    assert runs.run_voters(first, voters, store) == {"a": 4, "b": 4}
    assert runs.run_voters(first, voters, store) == {"a": 0, "b": 0}
    second = spark.createDataFrame([(1, "one"), (2, "two more"), (5, "five")], DOCS)
    assert runs.run_voters(second, {"a": voters["a"], "b": None}, store) == {"a": 2}
    assert [x for x in asked if x[1] != [1, 2, 3, 4]] == [("a", [2, 5])]
    now = {(r.voter, r.doc_id, r.text) for r in runs.current_votes(second, store).collect()}
    assert now == {("a", 1, "one"), ("b", 1, "one"), ("a", 2, "two more"), ("a", 5, "five")}
    assert [(r.doc_id, r.text) for r in runs.vote_and_merge(second, {}, store, 2).collect()] == [(1, "one")]
    # a run that broke off before its done rows is not seen, and the repeated one writes over it
    broken = spark.createDataFrame([(9, 0, 1, 0, 1, "x", vocab.DRUG, [], runs.digested(spark.createDataFrame([(9, "x")], DOCS)).first().digest, "a", "1-0")], runs.VOTE)
    broken.write.mode("append").partitionBy("voter", "run").parquet(f"{store}/votes")
    ninth = spark.createDataFrame([(9, "x")], DOCS)
    assert runs.current_votes(ninth, store).count() == 0
    assert runs.run_voters(ninth, {"a": voters["a"]}, store) == {"a": 1} and runs.current_votes(ninth, store).count() == 1
    # back to an earlier body: what was stored then counts again
    assert runs.run_voters(first, {"a": voters["a"]}, store) == {"a": 0}


def test_codes_meet_their_beginnings(spark):
    codes = spark.createDataFrame([("K10",), ("K1",), ("R07",), ("",)], "code string")
    asked = spark.createDataFrame([("K1",), ("K",), ("",), ("k",), ("K100",)], "prefix string")
    got = sorted((r.prefix, r.code) for r in K.by_prefix(codes, asked).collect())
    assert got == sorted((p, c) for p in ("K1", "K", "", "k", "K100") for c in ("K10", "K1", "R07", "") if c.startswith(p))


def test_spans_are_coded_by_dictionary_then_by_the_allowed_index(spark):
    near, far = [1.0, 0.0], [0.0, 1.0]
    spans = [(1, vocab.DIAGNOSIS, "Severe GERD today", near), (2, vocab.SYMPTOM, "coughing", far), (3, vocab.SYMPTOM, "dry cough", near), (4, vocab.DRUG, "gerd", near), (5, vocab.DIAGNOSIS, "other", None), (6, vocab.DIAGNOSIS, "odd", far)]
    df = spark.createDataFrame(spans, "id long, type string, text string, embedding array<float>")
    entries = {vocab.DIAGNOSIS: [("gerd", "K21"), ("severe", "Z00")], vocab.SYMPTOM: [("cough", "R05")]}
    valid = spark.createDataFrame([("K21",), ("R05",)], "code string")
    index = spark.createDataFrame([(1, "R10", near), (2, "K99", far), (3, "R99", [0.6, 0.8])], "vec_id long, code string, embedding array<float>")
    got = {r.id: (r.code, r.source) for r in K.code_spans(df, entries, valid, index, {vocab.DIAGNOSIS: "", vocab.SYMPTOM: "R"}).collect()}
    assert got == {1: ("K21", "dictionary"), 2: ("R99", "index"), 3: ("R05", "dictionary"), 4: (None, None), 5: (None, None), 6: ("K99", "index")}


def test_streamed_consensus_equals_the_batch(spark, tmp_path):
    """Votes in rounds, some twice, some late: what comes as final is what the votes in time agree on."""
    rng = random.Random(5)
    at = ["2024-01-01T00:00:00", "2024-01-01T01:00:00", "2024-01-01T02:00:00"]
    rows = []
    for i in range(300):
        r, late = rng.randrange(3), rng.random() < 0.1
        s = rng.randrange(4) * 5
        vote = (rng.choice("abcd"), 0, rng.randrange(6), i, s, s + 3, f"t{s}", rng.choice(vocab.TYPES[:2]), rng.choice([[], ["isNegated"]]), at[r])
        rows += [(*vote, "2024-01-01T09:00:00" if late else at[r])] * rng.choice([1, 1, 2])
    schema = stream.ARRIVED.replace("timestamp", "string")
    votes = spark.createDataFrame(rows, schema).withColumn("at", F.to_timestamp("at")).withColumn("arrived", F.to_timestamp("arrived"))
    votes = votes.withColumn("voter_ord", F.ascii("voter") - 97)
    votes.withColumn("part", F.hour("at")).repartition(1).write.partitionBy("part").json(f"file://{tmp_path}/in")
    end = spark.createDataFrame([("end", 0, 0, 0, 0, 0, "", "", [], "2024-01-02T12:00:00", "2024-01-02T12:00:00")], schema)
    end.write.json(f"file://{tmp_path}/in/part=9")
    source = spark.readStream.schema(stream.ARRIVED).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    merged = stream.consensus_stream(stream.split_late(source)[0], 2)
    run = merged.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{tmp_path}/out")
    run.awaitTermination()
    out = spark.read.parquet(f"file://{tmp_path}/out")
    got = {(r.round // 3_600_000 % 24, r.doc_id, r.start, r.type): (r.n_votes, list(r.assertions), r.text) for r in out.filter("kind = 'final'").collect()}
    want = {}
    for v in sorted({(*r[:8], tuple(r[8]), *r[9:]) for r in rows}, key=lambda r: (r[0], r[3])):
        if v[10] == v[9]:
            want.setdefault((int(v[9][11:13]), v[2], v[4], v[7]), []).append(v)
    # one vote of a voter on a span counts: the first that came
    assert {k: v[0] for k, v in got.items()} == {k: len({x[0] for x in v}) for k, v in want.items() if len({x[0] for x in v}) >= 2}
    assert out.filter("kind = 'agreed'").count() == len(got) and stream.split_late(votes)[1].count() == sum(r[10] != r[9] for r in rows)


def test_inverted_lists_hold_every_row_and_find_clustered_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.2).tolist()) for i in range(600)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    cells = Q.fit_cells(e, 12)
    lists = Q.inverted_lists(e, cells)
    assert lists.count() == 600 and {r.vec_id for r in lists.collect()} == set(range(600))
    exact = Q.dense_topk(q, e, 5)
    probes = Q.probes_needed(q, lists, cells, 5, 0.95)
    assert probes <= 4 and Q.recall(Q.ann_topk(q, lists, cells, 5, probes), exact).first().recall >= 0.9
    # asked for all cells, the search is the exact one
    every = {(r.query_id, r.rank, r.vec_id) for r in Q.ann_topk(q, lists, cells, 5, 12, block_rows=7).collect()}
    assert every == {(r.query_id, r.rank, r.vec_id) for r in exact.collect()}
    none = e.limit(0)
    empty = Q.fit_cells(none)
    assert Q.ann_topk(q, Q.inverted_lists(none, empty), empty, 5, 3).count() == 0
