"""Tokens are cut where documents are read; grams that no dictionary has are not shuffled."""

from spanloom.operators import linking as K
from spanloom.operators.structure import cut_tokens

BODIES = {1: "Đau  đầu nhẹ", 2: "", 3: " a", 4: "x", 5: "lạ \U0001f600 z ", 6: "one two three four"}


def test_tokens_are_placed_without_a_shuffle(spark):
    docs = spark.createDataFrame(list(BODIES.items()), "doc_id long, body string")
    cut = cut_tokens(docs.repartition(1), 2)
    assert "Exchange hashpartitioning" not in cut._jdf.queryExecution().executedPlan().toString()
    want = set()
    for i, body in BODIES.items():
        words, at = body.split(" "), 0
        for k, w in enumerate(words):
            want.add((i, k, at, w, *(words[k + 1 : k + 3] + [None, None])[:2]))
            at += len(w) + 1
    assert {tuple(r) for r in cut.collect()} == want
    some = cut_tokens(docs, 0, lambda doc_id, start, length: (length > 1) & (doc_id != 1))
    assert {(r.doc_id, r.w) for r in some.collect()} == {(d, w) for d, _, _, w, *_ in want if len(w) > 1 and d != 1}


def test_grams_of_ready_and_led_tokens(spark):
    docs = spark.createDataFrame(list(BODIES.items()), "doc_id long, body string")
    ready, led = K.ngrams(cut_tokens(docs, 2)), K.ngrams(cut_tokens(docs))
    assert {tuple(r) for r in ready.collect()} == {tuple(r) for r in led.collect()}
    terms = spark.createDataFrame([("đau  đầu", 1), ("two three", 2), ("one", 3), ("three four five", 4)], "gram string, value int")
    hits = K.dictionary_hits(cut_tokens(docs, 2), terms)
    assert {(r.doc_id, r.start, r.end, r.value) for r in hits.collect()} == {(1, 0, 8, 1), (6, 4, 13, 2), (6, 0, 3, 3)}
