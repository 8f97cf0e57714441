"""Further mentions are found by rows of numbers: one for each run of a document, whatever surfaces share its key."""

from spanloom.operators import builds as B

SPAN = "doc_id long, base_ord int, start int, end int, text string, type string, assertions array<string>"


def test_a_run_meets_one_row_and_carries_no_text(spark, monkeypatch):
    shown = ["Alpha beta", "alpha  beta", "ALPHA BETA", "alpha-beta", "alpha beta"]
    docs = [(1, "; ".join(shown)), (2, "; ".join(shown[::-1]) + "; xalpha beta"), (3, "none")]
    base, at = [], 0
    for k, t in enumerate(shown):
        base.append((1, k, at, at + len(t), t, "THỐC".replace("Ố", "UỐ") if k else "B", []))
        at += len(t) + 2
    seen, whole = [], B.beside
    monkeypatch.setattr(B, "beside", lambda rows, *a: seen.append((set(rows.columns), rows.count())) or whole(rows, *a))
    frames = spark.createDataFrame(base, SPAN), spark.createDataFrame(docs, "doc_id long, body string")
    for stage in (1, 2):
        got = {(r.doc_id, r.text) for r in B.repeat_scan(*frames, stage).collect()}
        assert got == {(2, t) for t in shown}
    # ten runs and five spans: five surfaces of one key do not make five rows of a run
    assert seen == [({"doc_id", "start", "end", "type", "_rank"}, 15)] * 2
