"""The audit against walking each order document by document."""

import random
import re
from itertools import permutations

import pytest

from spanloom.llm.filter_audit import filter_audit, text_failures

SCHEMA = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def plain_failures(text):
    words, t = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w], text or ""
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t)]


def plain_audit(rows, labels):
    marks = {}
    for d, q, t in labels:
        g, x = marks.get(d, (0, 0))
        marks[d] = (max(g, q == 1), max(x, t == 1))
    docs = []
    for d, text, source in rows:
        smaller = d is not None and any(o is not None and o < d and (u or "") == (text or "") for o, u, _ in rows)
        docs.append((source or "", [*plain_failures(text), smaller], *marks.get(d, (0, 0))))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                i = "ABCDE".index(f)
                gone, stay = [d for d in left if d[0][i]], [d for d in left if not d[0][i]]
                fails = [d for d in own if d[0][i]]
                total[f] += len(gone)
                out[part, order, step] = [len(stay), len(gone), len(fails) - len(gone), sum(sum(d[0]) == 1 for d in fails), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def audited(spark, rows, labels):
    got = filter_audit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got})
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}


def test_audit_is_the_walk_of_every_order(spark):
    rng = random.Random(4)
    rows = []
    for d in range(120):
        words = [rng.choice(["ab", "Cd", "é", "EF", "x|", "g#h"][: rng.randint(1, 6)]) + str(rng.randrange(rng.choice([3, 400]))) for _ in range(rng.choice([3, 150, 230]))]
        rows.append((d, " ".join(words), rng.choice(["one", "two", None, ""])))
    rows += [(200 + k, rng.choice(rows)[1], rng.choice(["one", "three"])) for k in range(40)]
    labels = [(d, rng.randint(0, 1), rng.randint(0, 1)) for d in range(0, 240, 2)] + [(0, 1, 1), (None, 1, 1), (4, None, None)]
    assert audited(spark, rows, labels) == plain_audit(rows, labels)


def test_nulls_repeats_ties_and_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(None, None, None), (None, "", "a"), (1, "", "a"), (1, "", "a"), (2, None, ""), (3, long, "a"), (4, long, "b"), (4, long, "b"), (None, long, "b")]
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, None)]
    assert audited(spark, rows, labels) == plain_audit(rows, labels)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit(none, labels).count() == 0
    docs = spark.createDataFrame([(1, "a", "s", 5, 6), (2, "a", "s", 5, 6)], SCHEMA + ", n long, digest long").withColumnRenamed("digest", "part")
    got = filter_audit(docs, labels.selectExpr("*", "1 AS a", "2 AS text", "3 AS source"))
    row = got.filter("filter_order = 'EABCD' AND step = 1").collect()
    assert [(r.part, r.kept, r.removed) for r in row] == [("s", 1, 1)] and got.count() == 600


@pytest.mark.parametrize("text", ["", " \t\n", "A" * 3, "é" * 40 + "A", "É" * 5, "a\x1cb", "a\xa0b c", "x y " * 150, "a$"])
def test_text_failures(text):
    assert list(text_failures(text.encode())) == plain_failures(text)
