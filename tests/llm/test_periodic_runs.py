"""Runs against trying every period at every place."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from spanloom.llm.periodic_runs import Names, branching_repeats, periodic_runs, planted_order, runs_of


def plain_runs(w, least=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        j = 0
        while j + q < len(w):
            k = j
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            if k + q - j >= max(least, 2 * q):
                out.setdefault((j, k + q), q)  # the smallest period of this stretch
            j = max(k, j + 1)
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, words):
    runs = plain_runs(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    told = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *told, sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
@pytest.mark.parametrize("least", [1, 12])
def test_runs_of_random_words(letters, least):
    rng = random.Random(letters)
    for _ in range(150):
        docs = [[rng.randrange(letters) for _ in range(rng.randint(0, 45))] for _ in range(3)]
        row = np.repeat(np.arange(3), [len(d) for d in docs])
        got = runs_of(np.array(sum(docs, []), dtype=np.int64), row, least).tolist()
        opens = np.cumsum([0, *(len(d) for d in docs)])
        assert got == [[s + o, e + o, q] for d, o in zip(docs, opens, strict=False) for s, e, q in plain_runs(d, least)]


def test_branching_repeats_are_all_of_them():
    rng = random.Random(9)
    w = [rng.randrange(2) for _ in range(120)]
    plain = {(i, q) for q in range(1, 61) for i in range(121 - 2 * q) if w[i : i + q] == w[i + q : i + 2 * q] and (i + 2 * q == 120 or w[i + q] != w[i + 2 * q])}
    place, period = branching_repeats(Names(np.array(w), np.zeros(120, dtype=np.int64)))
    assert set(zip(place.tolist(), period.tolist(), strict=True)) == plain


def test_names_measure_common_stretches():
    w = np.array([1, 2, 1, 2, 1, 3, 1, 2, 1, 2])
    names = Names(w, np.array([0] * 6 + [1] * 4))
    assert names.forward(np.array([0, 0, 6]), np.array([2, 6, 8])).tolist() == [3, 0, 2]
    assert names.backward(np.array([2, 5, 8]), np.array([4, 3, 10])).tolist() == [2, 3, 2]


def corpus(rng):
    rows = []
    for d in range(60):
        words = [f"w{rng.randrange(rng.choice([2, 30, 2000]))}" for _ in range(rng.choice([0, 1, 11, 12, 40, 90]))]
        for _ in range(rng.randint(0, 3)):
            at, unit = rng.randint(0, len(words)), [f"u{rng.randrange(50)}" for _ in range(rng.randint(1, 9))]
            words[at:at] = (unit * 9)[: rng.randint(1, 50)]
        rows.append((d, "".join(w + rng.choice([" ", "\n", " \t ", "\x0b"]) for w in words)))
    return rows


def test_rows_equal_plain_ones(spark):
    rows = corpus(random.Random(2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in periodic_runs(docs).collect()) == [plain_row(d, t.split()) for d, t in rows]


def test_planted_periods(spark):
    rows = corpus(random.Random(3))
    got = sorted(tuple(r) for r in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), planted_order).collect())
    want = []
    for d, t in rows:
        w, h = t.split(), zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        want.append(plain_row(d, w))
    assert got == want


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    long = " ".join(["one two three"] * 40_000 + ["four"] * 7)
    rows = [(None, None), (None, "a " * 20), (1, ""), (2, " \n\t"), (3, "a " * 12), (3, "a " * 12), (4, "a " * 11), (5, "A a " * 12), (6, "é\xa0b " * 13), (7, long), (8, "x" * 3_000_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_runs int")
    got = {(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in periodic_runs(docs).collect()}
    assert got == {
        *((d, 0, None, None, None, None) for d in (None, 1, 2, 4, 8)), (None, 1, 0, 20, 1, 20_000), (3, 1, 0, 12, 1, 12_000), (5, 1, 0, 24, 2, 12_000),
        (6, 1, 0, 13, 1, 13_000), (7, 1, 0, 120_000, 3, 40_000_000),
    }
    assert periodic_runs(docs).count() == 11 and periodic_runs(docs.limit(0)).count() == 0
    texts = {r.doc_id: r.collapsed for r in periodic_runs(docs, texts=True).collect()}
    assert texts[3] == "a" and texts[5] == "A a" and texts[7] == "one two three " + " ".join(["four"] * 7)
