"""Signatures against the element-at-a-time form, grouping against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm.components import connected_components
from spanloom.llm.near_dup import near_duplicates, representatives, spanning_links
from spanloom.llm.shingles import U, mix, shingle_sets, stream
from spanloom.llm.superminhash import EMPTY, signatures


def plain_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def plain_components(ids, texts, per_cent):
    sets, parent = plain_sets(texts), {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= per_cent * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), len(s)) for i, s in zip(ids, sets, strict=True)}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    originals = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 120))] for _ in range(12)]
    texts = []
    for _ in range(n):
        w = list(rng.choice(originals))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w) if rng.random() < 0.8 else " ".join(w).upper())
    return texts


def one_at_a_time(hashes, m):
    steps, sig = stream(2 * m, 3), np.full(m, EMPTY)
    for x in hashes:
        p = list(range(m))
        for level in range(m):
            r = mix(np.array([x], dtype=U) + steps[2 * level])[0]
            k = int(mix(np.array([x], dtype=U) + steps[2 * level + 1])[0] % U(m - level)) + level
            p[level], p[k] = p[k], p[level]
            sig[p[level]] = min(sig[p[level]], (U(level) << U(56)) | (r >> U(8)))
    return sig


@pytest.mark.parametrize("n", [1, 3, 20, 90])
def test_signature_is_superminhash(n):
    h = stream(n, 99)
    assert (signatures(h, np.zeros(n, dtype=np.int64), 1, 16)[0] == one_at_a_time(h, 16)).all()


def test_signature_estimates_similarity():
    a, b = stream(1000, 1), np.concatenate((stream(1000, 1)[:700], stream(300, 2)))
    sig = signatures(np.concatenate((a, b)), np.repeat([0, 1], 1000), 2, 128)
    assert abs((sig[0] == sig[1]).mean() - 700 / 1300) < 0.15


def test_empty_sets_have_empty_signatures():
    sig = signatures(stream(2, 5), np.array([1, 1]), 3, 8)
    assert (sig[0] == EMPTY).all() and (sig[2] == EMPTY).all() and (sig[1] != EMPTY).all()


def test_shingle_sets_count_like_plain_ones():
    texts = ["", " \t\n", "one", "A b\x0bC d", "a b c d e", "a b c d e f a b c d e f", "É é É é É é", "x" * 3000, "a\x1cb c\xa0d e f g"] + corpus(3, 30)
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(s) for s in plain_sets(texts)]


@pytest.mark.parametrize("per_cent", [80, 85])
def test_groups_equal_all_pairs(spark, per_cent):
    texts = corpus(1, 160)
    ids = list(range(10, 10 + len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_duplicates(docs, per_cent).collect()}
    assert got == plain_components(ids, texts, per_cent)


def test_blocks_give_the_same_groups(spark):
    texts = corpus(2, 90)
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_duplicates(docs, 85, block_sets=4).collect()}
    assert got == plain_components(ids, texts, 85)


def test_nulls_repeats_and_clashing_columns(spark):
    text = "a b c d e f g"
    rows = [(1, None, 5), (2, "", 5), (3, text, 5), (4, text.upper(), 6), (4, text.upper(), 6), (None, text, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumnRenamed("n", "bands")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept, r.n_shingles) for r in near_duplicates(docs).collect())
    assert got == [(0, 0, True, 3), (1, 1, True, 0), (2, 2, True, 0), (3, 3, True, 3), (4, 3, False, 3), (4, 3, False, 3)]
    assert near_duplicates(docs.limit(0)).count() == 0
    kept = sorted((r.doc_id or 0) for r in representatives(docs).collect())
    assert kept == [0, 1, 2, 3]
    assert representatives(docs).columns == docs.columns


def test_representatives_keep_one_row_of_a_repeated_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "other words here and there")], "doc_id long, text string")
    assert sorted(r.doc_id for r in representatives(docs).collect()) == [1, 2]


def test_spanning_links_of_two_blocks_only_cross():
    a = np.arange(20, dtype=U)
    links = spanning_links([a, a[:19], a[:18], a + U(100)], np.array([0, 0, 1, 1]), 85)
    assert {frozenset(x) for x in links} <= {frozenset((0, 1)), frozenset((0, 2)), frozenset((1, 2))} and len(links) == 2


def test_components_of_chains_and_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (8, 10), (20, 20), (30, 31), (30, 31)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {k: v for k, v in got.items() if k < 100} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 10: 8, 30: 30, 31: 30}
    assert {v for k, v in got.items() if k >= 100} == {100}
