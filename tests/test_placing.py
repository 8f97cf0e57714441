"""Items placed one after another: what stands before a place comes with the place."""

from pyspark.sql import functions as F

from spanloom.operators import builds as B

ITEM = "doc_id long, item_ord int, text string, before string"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contexts_are_not_cut_out_of_the_body_for_each_place(spark):
    body = "ab cd ab xy ab cd"
    docs = spark.createDataFrame([(1, body), (2, "none")], "doc_id long, body string")
    items = spark.createDataFrame([(1, 1, "ab", "cd "), (1, 2, "ab", ""), (1, 3, "cd", "y ab "), (2, 1, "ab", "cd ")], ITEM)
    got = B.context_candidates(items, docs)
    assert "substring(body" not in _plan(got)
    want = []
    for d, i, text, before in [(1, 1, "ab", "cd "), (1, 2, "ab", ""), (1, 3, "cd", "y ab ")]:
        for s in range(len(body)):
            if body.startswith(text, s):
                led = body[max(s - len(before), 0) : s]
                same = sum(n <= len(led) and led[-n:] == before[-n:] for n in range(1, len(before) + 1))
                want.append((d, i, -same, s, s + len(text)))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    alone = items.filter("before = ''")
    assert sorted(r.start for r in B.context_candidates(alone, docs).collect()) == [0, 6, 12]
    assert B.context_candidates(items.limit(0), docs).count() == 0


def test_ladder_does_not_carry_the_body_to_each_place(spark):
    docs = spark.createDataFrame([(1, "ab cd ab xy ab cd AB  cd")], "doc_id long, body string")
    items = spark.createDataFrame([(1, 1, "b", "xy a"), (1, 2, "ab cd", "")], ITEM)
    got = B.ladder_candidates(items, docs)
    assert "substring(body" not in _plan(got)
    rank = {(r.item_ord, r.start): r["rank"] for r in got.orderBy(F.desc("rank")).collect()}
    assert rank[1, 13] == 0 and rank[1, 1] == 1 and rank[2, 0] == 1 and rank[2, 18] == 3
