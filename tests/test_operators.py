"""Operators against plain Python on small random cases, and the table-driven cases of names, codes and labels."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions import text as T
from spanloom.operators import consensus as C
from spanloom.operators import edits as E
from spanloom.operators import linking as K
from spanloom.operators import locate as L
from spanloom.operators import metric as M
from spanloom.operators import records as R
from spanloom.operators import search as Q
from spanloom.operators import spans as S
from spanloom.operators import structure as ST


def random_spans(seed, docs=6, n=30):
    r = random.Random(seed)
    out = []
    for d in range(docs):
        for i in range(n):
            s = r.randrange(300)
            out.append((d, i, s, s + r.randint(1, 40), r.choice(vocab.TYPES[:2]), r.randint(1, 3)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, ord int, start int, end int, type string, n_votes int")


def touches(a, b):
    return a[2] < b[3] and a[3] > b[2]


@pytest.mark.parametrize("same_type", [False, True])
def test_overlap_flag(spark, same_type):
    a, b = random_spans(1), random_spans(2, n=5)
    got = {(r.doc_id, r.ord): r.hit for r in S.overlap_flag(frame(spark, a), frame(spark, b), "hit", same_type).collect()}
    assert got == {(x[0], x[1]): any(x[0] == y[0] and touches(x, y) and (not same_type or x[4] == y[4]) for y in b) for x in a}


def test_overlap_join_has_each_pair_once(spark):
    a, b = random_spans(3), random_spans(4)
    right = frame(spark, b).select("doc_id", F.col("ord").alias("r_ord"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    got = sorted((r.doc_id, r.ord, r.r_ord) for r in S.overlap_join(frame(spark, a), right, 16).collect())
    assert got == sorted((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and touches(x, y))


def test_islands_are_transitive_overlaps(spark):
    rows = random_spans(5, n=15)
    parent = {(x[0], x[1]): (x[0], x[1]) for x in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[4] == y[4] and touches(x, y):
                parent[find((x[0], x[1]))] = find((y[0], y[1]))
    got = {}
    for r in S.islands(frame(spark, rows), ["doc_id", "type"]).collect():
        got.setdefault((r.doc_id, r.type, r.island), set()).add((r.doc_id, r.ord))
    want = {}
    for x in parent:
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_greedy_equals_sequential(spark):
    rows = random_spans(6)
    df = frame(spark, rows).withColumn("text", F.lit("x")).withColumn("assertions", F.array(F.lit("a")))
    got = {(r.doc_id, r.start, r.end, r.type) for r in C.resolve_overlaps(df).collect()}
    want = set()
    for d in range(6):
        kept = []
        for x in sorted((x for x in rows if x[0] == d), key=lambda x: (-x[5], x[3] - x[2], x[2], vocab.TYPES.index(x[4]))):
            if not any(touches(x, k) for k in kept):
                kept.append(x)
        want |= {(x[0], x[2], x[3], x[4]) for x in kept}
    assert got == want


def test_touching_spans_do_not_overlap(spark):
    df = frame(spark, [(1, 0, 0, 4, "a", 1), (1, 1, 4, 8, "a", 1)])
    assert S.islands(df, ["doc_id"]).select("island").distinct().count() == 2
    assert {r.n for r in S.adjacent_overlaps(df).collect()} == {0}


def test_majority_ties_go_to_the_first_vote(spark):
    rows = [(1, "b", 1, 0, 0, 3, "abc", "t", ["y"]), (1, "a", 0, 5, 0, 3, "abc", "t", ["x"]), (1, "a", 0, 6, 0, 3, "abc", "t", ["x"]), (1, "c", 2, 0, 0, 3, "abc", "t", ["y"])]
    votes = spark.createDataFrame(rows, "doc_id long, voter string, voter_ord int, item_ord int, start int, end int, text string, type string, assertions array<string>")
    r = C.consensus(votes, 1).first()
    assert r.n_votes == 3 and r.assertions == ["x"]
    assert C.consensus(votes, 4).count() == 0
    assert C.cluster_consensus(votes, 9, trusted="b").first().assertions == ["y"]


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_wer_equals_dynamic_programming(spark):
    r = random.Random(7)
    pairs = [([r.choice("abcdefgh") * 3 for _ in range(r.randint(0, 30))], [r.choice("abcdefgh") * 3 for _ in range(r.randint(0, 30))]) for _ in range(60)]
    pairs += [([], []), ([], ["x"]), (["x"], []), ([f"w{i}" for i in range(3000)], [f"w{i}" for i in range(1, 3001)])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    for row in M.wer(df, "a", "b", "w").collect():
        a, b = pairs[row.i]
        assert row.w == pytest.approx(distance(a, b) / len(a) if a else (float("inf") if b else 0.0))
        assert M.word_distance(a, b) == distance(a, b)
    again = {r.i: r.w for r in M.wer_of_documents(df, "a", "b", "w").collect()}
    assert again == {r.i: r.w for r in M.wer(df, "a", "b", "w").collect()}


def test_word_distance_of_very_long_texts():
    r = random.Random(3)
    a = [f"w{int(r.paretovariate(0.7)) % 60_000}" for _ in range(100_000)]
    b = list(a)
    for _ in range(500):
        b[r.randrange(len(b))] = "other"
    b = b[7:50_000] + ["x", "y"] + b[50_000:]
    began = time.time()
    assert 490 <= M.word_distance(a, b) <= 509
    assert M.word_distance(a, b[::-1]) > 50_000 and time.time() - began < 60


def test_scores_of_special_sets(spark):
    schema = "doc_id long, ord int, start int, end int, type string, text string, assertions array<string>, codes array<string>"
    gold = spark.createDataFrame([(1, 0, 0, 3, "t", "abc", ["x"], ["1"]), (1, 1, 5, 8, "t", "abc", [], []), (2, 0, 0, 1, "t", "q", [], [])], schema)
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    same = M.evaluate(gold, gold, docs, ["text_type"], ("concat", "per_concept")).collect()
    assert all(r.final_score == pytest.approx(1.0) for r in same)
    none = M.evaluate(gold, gold.limit(0), docs, ["text_type"], ("concat",)).first()
    assert none.text_score == pytest.approx(1 / 3) and none.candidates_score == 0
    once = M.sample_scores(gold, gold.filter("ord = 0"), docs, ["text_type"], ("per_concept",)).filter("doc_id = 1").first()
    assert (once.text, once.assertions, once.codes, once.weight) == (0.5, 0.5, 0.5, 3)
    wild = M.sample_scores(gold.filter("doc_id = 1"), gold, spark.createDataFrame([(2,)], "doc_id long"), ["pos_type"], ("concat",)).first()
    assert wild.text == float("-inf")


@pytest.mark.parametrize(
    ("text", "reason"),
    [("", "empty"), ("  ", "empty"), ("a ***** b", "masked"), ("Huyết áp", "banned term"), ("130/76 mmHg", "vital value"), ("55 %", None), (" a", "edge space"), (";a", "edge punctuation"), ("a (b", "unbalanced bracket"), ("chụp (CT)", None), ("HCO3-", None)],
)
def test_banned(spark, text, reason):
    assert spark.createDataFrame([(text,)], "t string").select(T.banned(F.col("t"))).first()[0] == reason


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    for code, want in [("D550", "D55.0"), ("I10", "I10"), ("D55.0", "D55.0"), ("12345", "12345"), (" d550 ", "D55.0"), ("", ""), (None, "")]:
        assert pick(T.dot(F.lit(code).cast("string"))) == want
    assert pick(T.undot(F.lit("D55.0"))) == "D550"
    for x in ("a\\n\nb\rc\\", "\\\\n", "plain"):
        assert pick(T.unescape(T.escape(F.lit(x)))) == x
    for x, want in [("1,5", 1.5), (" 2.5 ", 2.5), ("", None), ("n/a", None)]:
        assert pick(T.lenient_double(F.lit(x))) == want
    for a, b, want in [([], [], 1.0), (["a"], [], 0.0), (["a", "b"], ["b"], 0.5), (None, None, 1.0)]:
        assert pick(T.jaccard(F.lit(a).cast("array<string>") if a is not None else F.lit(None).cast("array<string>"), F.lit(b).cast("array<string>") if b is not None else F.lit(None).cast("array<string>"))) == want
    assert pick(T.cells(F.lit(" a; ;b"))) == ["a", "b"] and pick(T.words(F.lit(" a  b\tc "))) == ["a", "b", "c"]
    assert pick(T.context_window(F.lit("ab\ncdef"), F.lit(3), F.lit(5), 2)) == "b 【cd】ef"


def test_locate_cases(spark):
    docs = spark.createDataFrame([(1, "aaa bcd aaa xyz, bcd; end"), (2, "cafe\u0301 au lait")], "doc_id long, body string")
    rows = [(1, "v", 0, "aa", "t", "", ""), (1, "v", 1, "xyz", "t", "wrong", "wrong"), (1, "v", 2, "bcd", "t", "aaa ", ""), (1, "v", 3, "bcd", "t", "zz", "zz"), (1, "v", 4, "none", "t", "", ""), (2, "v", 5, "caf\u00e9", "t", "", "")]
    votes = spark.createDataFrame(rows, "doc_id long, voter string, item_ord int, text string, type string, before string, after string").withColumn("assertions", F.array(F.lit("x")))
    got = {r.item_ord: (r.start, r.end, r.mode, r.reason) for r in L.locate_group(votes, docs).collect()}
    assert got == {0: (0, 2, "exact", "ordinal"), 1: (12, 15, "exact", "accepted"), 2: (4, 7, "exact", "accepted"), 3: (None, None, None, "context"), 4: (None, None, None, "not found"), 5: (0, 5, "nfc", "accepted")}
    strict = {r.item_ord: r.reason for r in L.locate_strict(votes, docs).collect()}
    assert strict == {0: "ambiguous", 1: "accepted", 2: "accepted", 3: "context", 4: "not found", 5: "accepted"}
    assert L.find_all("aaaa", ["aa", ""]) == {"aa": [(0, 2, "exact"), (1, 3, "exact"), (2, 4, "exact")], "": []}


def test_equal_requests_take_places_in_order(spark):
    docs = spark.createDataFrame([(1, "go x go x go x")], "doc_id long, body string")
    votes = spark.createDataFrame([(1, "v", i, "go", "t", "", " x") for i in range(4)], "doc_id long, voter string, item_ord int, text string, type string, before string, after string").withColumn("assertions", F.array(F.lit("x")))
    got = [(r.start, r.reason) for r in L.locate_group(votes, docs).orderBy("item_ord").collect()]
    assert got == [(0, "ordinal"), (5, "ordinal"), (10, "ordinal"), (None, "surplus")]


def test_sections(spark):
    text = "1.  Tiền sử bệnh\n- thuốc a\nLý do: đau đầu \nThuốc trước khi nhập viện\n- thuốc b\n\nNhãn:\n2. Bệnh sử\nmột dòng\x0bhai dòng  "
    rows = ST.parse_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    assert [(r.text, r.section, r.sub, r.kind) for r in rows] == [
        ("thuốc a", "tiền sử bệnh", "", "bullet"), ("đau đầu", "tiền sử bệnh", "lý do", "value"), ("thuốc b", "tiền sử bệnh", "thuốc trước khi nhập viện", "bullet"),
        ("một dòng", "bệnh sử", "", "plain"), ("hai dòng", "bệnh sử", "", "plain"),
    ]
    assert all(text[r.start : r.end] == r.text for r in rows) and [r.historical for r in rows] == [True, True, True, False, False]


def test_masks(spark):
    text = "x *** y ***** **"
    got = [(r.start, r.end, r.mask_len, r.left, r.right) for r in ST.mask_runs(spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string")).collect()]
    assert got == [(2, 5, 3, "x ", " y ***** **"), (8, 13, 5, "x *** y ", " **")]


@pytest.mark.parametrize(
    ("name", "want"),
    [("avenol 10 MG Oral Tablet", ("avenol", "10 mg", "oral tablet")), ("24 HR brixin succinate 50 MG Extended Release Oral Tablet", ("brixin succinate", "50 mg", "extended release oral tablet")), ("2.67 ML corvan 10 MG/ML Injection", ("corvan", "10 mg/ml", "injection")), ("a 325 MG / b 5 MG Oral Tablet", ("a 325 mg / b", "5 mg", "oral tablet")), ("no strength", None), ("10 MG Oral Tablet", None)],
)
def test_clinical_names(spark, name, want):
    got = spark.range(1).select(K.clinical_name(F.lit(name)).alias("p")).first().p
    assert (tuple(got) if got else None) == want


def test_salts_and_brands(spark):
    pick = lambda c: spark.range(1).select(c).first()[0]
    assert pick(K.strip_salt(F.lit("avenol sodium chloride"))) == "avenol" and pick(K.strip_salt(F.lit("sodium"))) == "sodium"
    assert pick(K.brand(F.lit("x 1 MG Tab [Brand  One]"))) == "brand one" and pick(K.brand(F.lit("x"))) is None
    assert pick(K.ingredients_only(F.lit("a 325 MG / b"))) == "a / b"
    assert [pick(K.is_dosed(F.lit(t))) for t in ("avenol 10 mg po", "avenol cho ho", "avenol")] == [True, False, False]


def test_edits_keep_rows_and_claims(spark):
    base = spark.createDataFrame([(1, 1, 0, 10, "loét và đau", "a", ["x"]), (1, 2, 20, 24, "abcd", "a", [])], "doc_id long, base_ord int, start int, end int, text string, type string, assertions array<string>")
    proposals = spark.createDataFrame([(1, "abcd", "bc"), (1, "loét và đau", "dài hơn nhiều lắm")], "doc_id long, old string, new string")
    got = {r.base_ord: (r.start, r.end, r.outcome) for r in E.tighten(base, proposals).collect()}
    assert got == {1: (0, 10, "not a shorter piece"), 2: (21, 23, "tightened")}
    changed = base.withColumn("assertions", F.array(F.lit("y")))
    assert {r.status for r in E.diff(base, changed).collect()} == {"labels"} and {r.status for r in E.diff(base, base.limit(0)).collect()} == {"removed"}
    with pytest.raises(ValueError):
        E.fix_assertions(base, base, 1, "other")


def test_samples_and_topk(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "id long, size long")
    got = sorted(r.size for r in R.systematic_sample(df, "size", "id", 30).collect())
    assert got == sorted({int(k * 101 / 30) for k in range(30)})
    index = spark.createDataFrame([(i, [float(i == 0), float(i == 1), 1.0]) for i in range(4)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(9, [1.0, 0.0, 1.0])], "query_id long, embedding array<float>")
    assert [r.vec_id for r in Q.dense_topk(queries, index.repartition(3), 3).orderBy("rank").collect()] == [0, 2, 3]
    assert Q.dense_topk(queries.limit(0), index, 2).count() == 0


def test_best_rare_token_term_equals_plain(spark):
    from spanloom.operators import search as Q

    terms = {1: "alpha beta gamma", 2: "alpha beta delta", 3: "common rare", 4: "common", 5: "common rare"}
    docs = {i: "common" for i in range(40)} | {40: "alpha beta gamma", 41: "rare common", 42: "beta alpha", 43: "nothing here", 44: ""}
    t = spark.createDataFrame([(i, w) for i, x in terms.items() for w in x.split(" ")], "term_id long, w string")
    d = spark.createDataFrame([(i, w) for i, x in docs.items() for w in x.split(" ")], "doc_id long, w string")
    for threshold in (0.88, 0.6):
        want = {}
        for i, x in docs.items():
            a = set(x.split())
            got = [(len(a & set(y.split())) / len(a | set(y.split())), -k) for k, y in terms.items()]
            if max(got)[0] >= threshold:
                want[i] = (-max(got)[1], round(max(got)[0], 6))
        assert {r.doc_id: (r.term_id, round(r.score, 6)) for r in Q.rare_token_best(t, d, threshold=threshold).collect()} == want


def test_whole_queries_take_every_mention_and_vote(spark, data):
    import re

    from spanloom.plans import views as V
    from spanloom.plans.catalogue import QUERIES

    bodies = {r.doc_id: r.body for r in V.docs(spark, data).collect()}
    mentions = V.mentions(spark, data).select("doc_id", "text").collect()
    want = {}
    for r in mentions:
        if (r.doc_id, r.text) not in want:
            at = [m.start() for m in re.finditer(f"(?={re.escape(r.text)})", bodies[r.doc_id])]
            want[r.doc_id, r.text] = (len(at), at[0], at[-1])
    assert {(r.doc_id, r.text): (r.n, r.first, r.last) for r in QUERIES["locate_all"](spark, data).collect()} == want
    votes = V.votes(spark, data).count()
    for name in ("locate_group_ordinal", "locate_strict_reasons", "locate_first"):
        assert QUERIES[name](spark, data).count() == votes
    assert QUERIES["roundtrip"](spark, data).collect()[0].n == len(mentions)
