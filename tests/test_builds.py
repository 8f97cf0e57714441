"""Builds, flexible repeats, Unicode search, readers and drafts against plain loops."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.operators import builds as B
from spanloom.operators import edits as E
from spanloom.operators import linking as K
from spanloom.operators import locate as L
from spanloom.operators import records as R
from spanloom.operators import search as Q
from spanloom.sources import readers

D, S, LAB = vocab.DIAGNOSIS, vocab.SYMPTOM, vocab.LAB_NAME
SPAN = "doc_id long, base_ord int, start int, end int, text string, type string, assertions array<string>"


def small_corpus(seed, n=12):
    rng = random.Random(seed)
    words = ["AST", "ast", "NT", "pro", "BNP", "đau", "Đau", "ngực", "K", "sốt", "12", "ho", "a", "viêm", "phổi"]
    docs = []
    for i in range(n):
        out = ""
        for _ in range(rng.randint(5, 40)):
            out += rng.choice(words) + rng.choice([" ", " ", "-", " - ", "  ", ", ", ". ", "–"])
        docs.append((i, out))
    return docs, rng


def free(s, e, taken):
    return all(min(e, b) <= max(s, a) for a, b in taken)


def plain_by_context(body, text, before, taken):
    """By trying every place: how many characters of ``before`` stand there, counted one by one."""
    scored = []
    for s in range(len(body) - len(text) + 1):
        if body.startswith(text, s) and free(s, s + len(text), taken):
            k = 0
            while k < len(before) and k < s and before[-k - 1] == body[s - k - 1]:
                k += 1
            scored.append((k, s))
    most = max(scored, default=(0, 0))[0]
    best = [s for k, s in scored if k == most]
    if len(scored) != 1 and (len(best) != 1 or most < 3):
        return None
    return best[0], best[0] + len(text)


def plain_by_ladder(body, text, before, taken):
    """By trying every stretch of the body, each rank in turn."""
    text, before = text.strip(), before[-15:].strip()

    def bare(t):
        return " ".join(re.split(r"[\s\-–—]+", t.lower()))

    stretches = [(s, e) for s in range(len(body)) for e in range(s + 1, min(len(body), s + 3 * len(text) + 6) + 1)]
    exact = [(s, e) for s, e in stretches if body[s:e] == text]
    after = [(s, e) for s, e in exact if before and body[:s].endswith(before)][:1]
    solid = [(s, e) for s, e in stretches if not re.match(r"[\s\-–—]", body[s]) and not re.match(r"[\s\-–—]", body[e - 1])]
    loose = [(s, e) for s, e in solid if bare(body[s:e]) == bare(text).strip()]
    led = [(s, e) for s, e in loose if bare(before).strip() and bare(body[:s]).endswith(bare(before).strip())]
    return next((x for x in after + exact + led + (loose if len(text) > 2 else []) if free(*x, taken)), None)


def test_items_take_their_places_in_order(spark):
    docs, rng = small_corpus(1)
    base = [(i, 1, 0, 3, b[:3], S, []) for i, b in docs]
    items = []
    for i, body in docs:
        for k in range(10):
            at = rng.randrange(0, max(1, len(body) - 8))
            text = body[at : at + rng.randint(1, 8)].strip()
            shown = text.swapcase() if k % 4 == 3 else text
            items.append((i, k, shown, rng.choice([S, D, LAB, "other"]), body[max(0, at - rng.randint(0, 6)) : at], at if k % 3 == 0 else None, ["isFamily", "bad"]))
    df = spark.createDataFrame(items, "doc_id long, item_ord int, text string, type string, before string, at int, assertions array<string>").repartition(3)
    codes = spark.createDataFrame([("đau", D, ["R52"])], "surface string, type string, codes array<string>")
    frames = spark.createDataFrame(base, SPAN), spark.createDataFrame(docs, "doc_id long, body string")
    for rule, place in ((B.context_candidates, plain_by_context), (B.ladder_candidates, plain_by_ladder)):
        added, reasons = B.add_items(frames[0], df, frames[1], codes, rule)
        got = {(r.doc_id, r.item_ord): (r.start, r.end, r.text, r.codes) for r in added.collect()}
        want, why = {}, {}
        for i, body in docs:
            taken = [(0, 3)]
            for _, k, text, kind, before, at, _ in sorted(x for x in items if x[0] == i):
                if kind == "other" or kind != LAB and len(text.split()) < 2 and len(text) < 5:
                    why[i, k] = "unknown type" if kind == "other" else "short term"
                    continue
                if at is not None:
                    spot = (at, at + len(text)) if text and body[at : at + len(text)] == text and free(at, at + len(text), taken) else None
                else:
                    spot = place(body, text, before, taken) if text else None
                why[i, k] = "placed" if spot else "not found" if at is None else "wrong place"
                if spot:
                    taken.append(spot)
                    shown = body[spot[0] : spot[1]]
                    want[i, k] = (*spot, shown, ["R52"] if kind == D and shown.lower().strip() == "đau" else [])
        assert got == want and {(r.doc_id, r.item_ord): r.reason for r in reasons.collect()} == why
    assert E.recode(frames[0], codes, F.lit(True)).count() == len(docs)


def test_places_of_single_items(spark):
    body = "đau ngực, rồi đau lưng; AST - 3 và ast–3"
    docs = spark.createDataFrame([(1, body)], "doc_id long, body string")
    none = spark.createDataFrame([], "doc_id long, start int, end int")

    def placed(rule, text, before, taken=()):
        item = spark.createDataFrame([(1, 0, text, before, None)], "doc_id long, item_ord int, text string, before string, at int")
        base = spark.createDataFrame([(1, *t) for t in taken], none.schema)
        return B.place_items(item, base, docs, rule).select("start", "end", "reason").first()

    assert placed(B.context_candidates, "đau", "rồi ") == (14, 17, "placed")
    assert placed(B.context_candidates, "đau", "xx") == (None, None, "not found")
    assert placed(B.context_candidates, "đau", None, [(0, 3), (1, 4)]) == (14, 17, "placed")
    assert placed(B.ladder_candidates, "đau", "rồi ") == (0, 3, "placed")  # a blank between is not right after
    assert placed(B.ladder_candidates, "AST-3", "") == (24, 31, "placed")
    assert placed(B.ladder_candidates, "ast 3", "", [(24, 31)]) == (35, 40, "placed")
    assert placed(B.ladder_candidates, "k", "")[2] == placed(B.ladder_candidates, " ", "")[2] == "not found"


@pytest.mark.parametrize("stage", [1, 2])
def test_repeats_equal_a_pattern_scan(spark, stage):
    docs, rng = small_corpus(7, 16)
    base = []
    for i, body in docs[:8]:
        for k, m in enumerate(re.finditer(r"[0-9A-Za-zÀ-ỹ]+(?:[\s\-–]+[0-9A-Za-zÀ-ỹ]+)?", body)):
            if k % 5 == 0:
                base.append((i, k, m.start(), m.end(), m[0], rng.choice([S, D]), []))
    got = {(r.doc_id, r.start, r.end, r.text) for r in B.repeat_scan(spark.createDataFrame(base, SPAN), spark.createDataFrame(docs, "doc_id long, body string"), stage).collect()}
    surfaces, want = {x[4] for x in base}, set()

    def bare(t):
        return tuple(p for p in re.split(r"([^\W_]+|[^\w\s\-–—])", re.sub(r"[\s\-–—]+", " ", t.lower().strip(" -–—"))) if p)

    for i, body in docs:
        hits = []
        for s in range(len(body)):
            for e in range(s + 1, min(len(body), s + 30) + 1):  # every stretch of the text
                shown = body[s:e]
                if s and body[s - 1].isalnum() or e < len(body) and body[e].isalnum() or shown != shown.strip(" -–—"):
                    continue
                for text in surfaces:
                    short = len(text.split()) < 2 and len(text) < 5
                    number = re.match(r"^[\d.,]+$", text)
                    exact = shown == text and not short and stage == 1
                    loose = stage == 2 and bare(shown) == bare(text) and not (short and number) and (short or shown != text)
                    if (exact or loose) and free(s, e, [(x[2], x[3]) for x in base if x[0] == i]):
                        hits.append((s, e))
        taken = []
        for s, e in sorted(set(hits), key=lambda h: (h[0] - h[1], h[0])):
            if free(s, e, taken):
                taken.append((s, e))
                want.add((i, s, e, body[s:e]))
    assert got == want and want


def test_surfaces_of_three_hundred_words_are_repeated(spark):
    words = [f"word{i % 37}x{i}" for i in range(300)]
    docs = [(1, " ".join(words)), (2, "so " + " - ".join(w.upper() for w in words) + " it was"), (3, " ".join(words[:299]) + " other")]
    base = [(1, 0, 0, len(docs[0][1]), docs[0][1], S, []), (1, 1, 0, 5, "a b c", D, [])]
    got = B.repeat_scan(spark.createDataFrame(base, SPAN), spark.createDataFrame(docs, "doc_id long, body string"), 2).collect()
    assert [(r.doc_id, r.start, r.end, r.type) for r in got] == [(2, 3, len(docs[1][1]) - 7, S)]
    assert B.repeat_scan(spark.createDataFrame([], SPAN), spark.createDataFrame(docs, "doc_id long, body string")).count() == 0


def test_unicode_forms_are_found():
    body = "Đau đầu, đau bụng. đau đầu"
    for form in ("NFC", "NFD"):
        for other in ("NFC", "NFD"):
            text, needle = unicodedata.normalize(form, body), unicodedata.normalize(other, "đau đầu")
            hits = L.find_nfc(text, [needle])[needle]
            assert [unicodedata.normalize("NFC", text[s:e]) for s, e, _ in hits] == ["đau đầu"], (form, other)
    long = unicodedata.normalize("NFD", "đau bụng âm ỉ " * 4000)
    assert len(L.find_nfc(long, ["âm ỉ"])["âm ỉ"]) == 4000 and L.find_nfc("ascii only", ["é"]) == {"é": []} and L.find_nfc("x", [""]) == {"": []}


def test_rescue_finds_texts_anywhere(spark):
    docs = [(1, "xxabcdefyy and more"), (2, "abc only here"), (3, "k before q, q"), (4, "abc")]
    lost = [(1, "abcdef", ""), (2, "abc", ""), (3, "q", "before "), (4, "zz", ""), (5, "", ""), (6, "more", None)]
    got = L.rescue_unique(spark.createDataFrame(lost, "id long, text string, before string"), spark.createDataFrame(docs, "doc_id long, body string")).collect()
    assert {(r.id, r.doc_id, r.start) for r in got} == {(1, 1, 2), (3, 3, 9), (6, 1, 15)}
    assert L.rescue_unique(spark.createDataFrame([], "id long, text string, before string"), spark.createDataFrame(docs, "doc_id long, body string")).count() == 0


def test_parts_tell_what_is_wrong(spark, tmp_path):
    for name, text in (("a_1-5.json", "{}"), ("a_6-9.json", '{"6": [{"text": "x", "type": "y"}]}'), ("b_1-5.json", '{"1": [{"te'), ("b_6-9.json", "[]"), ("c_1-5.json", " "), ("notes.txt", "{}")):
        (tmp_path / name).write_text(text)
    rows = {(r.voter, r.low): (r.ok, r.reason) for r in readers.read_vote_parts(spark, str(tmp_path)).collect()}
    assert rows == {("a", 1): (True, None), ("a", 6): (True, None), ("b", 1): (False, "broken JSON"), ("b", 6): (False, "no object"), ("c", 1): (False, "empty file")}
    two = tmp_path / "two"
    two.mkdir()
    (two / "a_1-5.json").write_text('{"3": [{"text": "first"}]}')
    (two / "a_4-9.json").write_text('{"3": [{"text": "second"}]}')
    parts = readers.read_vote_parts(spark, str(two))
    assert [readers.merge_parts(parts, last).first()["items"][0].text for last in (False, True)] == ["first", "second"]


def test_forced_drugs(spark):
    rows = [(1, "avenol 10 mg po", S), (2, "avenol", D), (3, "dị ứng avenol", D), (4, "avenol pain", S), (5, "avenol bid", vocab.DRUG), (6, "corvan acid 5 mg", S), (7, "other 5 mg", S), (8, " ", S)]
    index = spark.createDataFrame([("avenol",), ("corvan acid",)], "gram string")
    got = {r.id: r.type for r in K.force_drugs(spark.createDataFrame(rows, "id int, text string, type string"), index).collect()}
    assert {i for i, t in got.items() if t == vocab.DRUG} == {1, 2, 5, 6} and len(got) == 8


def test_votes_are_cleaned(spark):
    rows = [(1, "x y", f" {S} ", ["isNegated", "isFamily", "isNegated", "zz"]), (2, None, S, None), (3, "x", "zz", []), (4, "***", S, []), (5, "huyết áp", S, [])]
    got = {r.id: (r.type, r.assertions, r.reason) for r in R.clean_votes(spark.createDataFrame(rows, "id int, text string, type string, assertions array<string>")).collect()}
    assert got[1] == (S, ["isFamily", "isNegated"], "accepted") and [got[i][2] for i in (2, 3, 4, 5)] == ["broken item", "unknown type", "banned: masked", "banned: banned term"]


def test_topk_tiles_equal_a_sort(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).round(1).astype(np.float32)
    v[100:130] = v[0]
    best_s, best_i = np.full((40, 7), -np.inf, dtype=np.float32), np.full((40, 7), -1, dtype=np.int64)
    scores = v[:40] @ v.T
    for at in range(0, 300, 32):
        Q._merge_tile(best_s, best_i, scores[:, at : at + 32], np.arange(at, min(at + 32, 300)))
    want = np.lexsort((np.broadcast_to(np.arange(300), scores.shape), -np.round(scores, 6)), axis=1)[:, :7]
    assert (best_i == want).all()


def test_diff_report_counts_axes(spark):
    a = [(1, 1, 0, 3, "abc", D, ["isFamily"]), (1, 2, 5, 8, "def", S, [])]
    b = [(1, 1, 0, 3, "abc", D, []), (1, 3, 9, 12, "ghi", D, [])]
    r = B.diff_report(spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN)).first()
    assert (r.added, r.removed, r.labels, r.codes, r.coded_delta, r.axes, r.verdict) == (1, 1, 1, 0, 1, 3, "several axes")
    made, reports = B.run_edits(spark.createDataFrame(a, SPAN), [("same", lambda x: x), ("none", lambda x: x.limit(0))])
    assert {x.job: x.verdict for x in reports.collect()} == {"same": "nothing changed", "none": "one axis"} and made["none"].count() == 0
