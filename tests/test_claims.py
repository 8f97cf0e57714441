"""Dictionary hits that are claimed where documents were cut."""

import random

import numpy as np
from pyspark.sql import functions as F

from spanloom.operators import linking as K
from spanloom.operators import spans as S
from spanloom.operators.structure import cut_tokens
from spanloom.plans import catalogue


def test_claims_by_document_equal_those_by_island(spark):
    rng = random.Random(4)
    rows = [(d, s, s + rng.randrange(1, 9), rng.choice("abc")) for d in range(40) for s in (rng.randrange(300) for _ in range(rng.choice([1, 5, 200])))]
    spans = spark.createDataFrame(rows, "doc_id long, start int, end int, term string")
    order = [F.col("start") % 3, -(F.col("end") - F.col("start"))]
    want = S.greedy(spans, order, ["term"]).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = S.greedy_by_document(spans.repartition(3, "doc_id").sortWithinPartitions("doc_id"), order, ["term"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want) and len(got) < len(rows)


def test_hits_are_not_shuffled(spark, data):
    for name in ("layered_claim", "lexicon_longest_first"):
        plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan  # one by gram and one by document before


def test_what_the_filter_lets_pass_is_told_apart(spark, monkeypatch):
    """With a filter that lets all pass, the list of what no dictionary has, or the join, decides."""
    monkeypatch.setattr(K, "_filter", lambda known: spark.sparkContext.broadcast(np.full(1 << 17, -1, dtype=np.int64)))
    docs = spark.createDataFrame([(1, "ab cd ef ab gh"), (2, "cd ef"), (3, "xy")], "doc_id long, body string")
    known = spark.createDataFrame([("ab", 2), ("cd ef", 5), ("ef", 2), ("ef ab gh", 8)], "gram string, value int")
    want = {(r.doc_id, r.start, r.end, r.gram, r.value) for r in S.greedy(K.ngrams(cut_tokens(docs, 2)).join(known, "gram"), [F.col("start"), -F.col("n")], ["gram", "value", "n"]).collect()}
    assert want == {(1, 0, 2, "ab", 2), (1, 3, 8, "cd ef", 5), (1, 9, 11, "ab", 2), (2, 0, 5, "cd ef", 5)}
    for most in (K.MOST_FALSE, 1):
        monkeypatch.setattr(K, "MOST_FALSE", most)
        assert {(r.doc_id, r.start, r.end, r.gram, r.value) for r in K.known_longest(cut_tokens(docs, 2), known).collect()} == want


def test_further_mentions_are_shuffled_once(spark):
    spans = spark.createDataFrame([(1, 0, 3)], "doc_id long, start int, end int")
    hits = spark.createDataFrame([(1, 2, 5, "abc", "t"), (1, 4, 6, "de", "t"), (1, 5, 9, "efgh", "t"), (2, 0, 3, "abc", "t")], "doc_id long, start int, end int, text string, type string")
    out = K.repeats(spans, hits)
    assert {(r.doc_id, r.start, r.end) for r in out.collect()} == {(1, 5, 9), (2, 0, 3)}
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
