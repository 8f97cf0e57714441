"""HTML extraction, toxicity, chat formatting, the pipeline."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from spanloom.llm import chat, html_text, toxicity
from spanloom.llm import queries as Q

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a>One</a></li></ul></nav><div class="sidebar">Side words, many of them.</div>
<div id=main-text><h1>The &amp; title</h1><p>First  paragraph,\n with <b>bold</b> text.</p><!-- note --><p>Second one; it has <a href=x>a link</a>, too.<ul><li>Point one.</li><li>Point two.</li></ul></div>
<div class="comments"><p>Nice article, thanks.</p></div><form><input><button>Send</button></form><footer>&copy; 2020</footer></body></html>"""


def test_content_without_an_article_element():
    assert html_text.main_text(PAGE) == "The & title\n\nFirst paragraph, with bold text.\n\nSecond one; it has a link, too.\n\nPoint one.\n\nPoint two."


def test_article_element_and_broken_markup():
    page = "<body><div class=ad>Buy now.</div><article><h1>Head</h1><p><b>A one.<br><p>B &lt;two&gt;.</article><p>Outside, text here.</p></body>"
    assert html_text.main_text(page) == "Head\n\nA one.\n\nB <two>."
    for odd in ("", "plain text, only.", "<p>x", "<", "<p", "</p></div>text, here.", "<script>never ends", "<p>a<!-- never ends", "<article></article>"):
        html_text.main_text(odd)
    assert html_text.main_text("plain text, only.") == "plain text, only."


def test_inline_boilerplate_goes_alone():
    for tag in ('<span class="tag">News</span>', '<a class="share" href=x>Share</a>', '<b class="notice">Note</b>', "<span hidden>secret</span>"):
        for page in (f"<p>{tag} A long paragraph, with text.</p>", f"<p>A long paragraph, {tag}with text.</p>", f"<article><p>{tag}A long paragraph, with text.</p></article>"):
            assert html_text.main_text(page) == "A long paragraph, with text."
    assert html_text.main_text('<span class="ad"><p>Buy, now.</p></span><p>Real text, here.</p>') == "Real text, here."


LONG = "A long paragraph of real article text, with commas and stops. And more of it; so that it counts."


def test_article_text_under_doubtful_names_stays():
    page = f"""<body><nav><a>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><div class="related-work">{LONG}</div><p class="legal">{LONG}</p><p>x &lt; <math><mi>y</mi></math></p>
      <div class="share">Share: <a>One</a> <a>Two</a></div><section class="comments"><p>{LONG}</p></section><ul class="tags"><li><a>tag</a></li></ul><aside>{LONG}</aside></article><footer>{LONG}</footer>"""
    assert html_text.main_blocks(page) == ["Title", LONG, LONG, LONG, "x < y"]
    assert html_text.main_blocks(f"<main><p>{LONG}</p><ul><li><a href=x>A linked source</a></li><li>Plain</li></ul><p>Of.</p></main>") == [LONG, "A linked source", "Plain", "Of."]
    unmarked = f'<body><div class="menu"><a>Home</a> <a>News</a></div><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><ul><li><a>One</a></li><li><a>Two</a></li></ul>'
    assert html_text.main_blocks(unmarked) == ["Head", LONG, LONG]


def test_deep_and_unclosed_pages_take_linear_time():
    import time

    began = time.time()
    for step in ("<div>", "<ul><li>", "<li><b>", "</i><b>", "<p><i>", "<td><tr>"):
        assert html_text.main_text(step * 100_000 + LONG) == LONG
    assert time.time() - began < 60


def test_pages_of_the_table(spark, data):
    import re
    from html import unescape

    html = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in Q.op8_html(spark, data).collect():
        inner = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        want = [" ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        assert r.text == "\n\n".join(x for x in want if x) and r.n_chars == len(r.text)


def test_page_edges(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 1), (2, "u", "<p>a, b.</p>", 1), (2, "u", "<p>a, b.</p>", 1)], "page_id long, url string, html string, text int")
    assert Counter((r.page_id, r.text, r.n_chars) for r in html_text.extract_pages(pages).collect()) == Counter({(1, "", 0): 1, (None, "", 0): 1, (2, "a, b.", 5): 2})
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_smoothing():
    assert html_text.smooth([0, 3, 6]) == [1.5, 3, 4.5] and html_text.smooth([]) == []


# ---- toxicity


def labelled(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "bcdfgklm" for b in ("anto", "eril", "osip", "ulem", "inar", "otes")]
    rows = []
    for i in range(n):
        w, y = list(rng.choice(words, int(rng.integers(1, 80)))), int(rng.random() < 0.3)
        if y:
            w.insert(int(rng.integers(0, len(w) + 1)), str(rng.choice(["vile", "vilest", "scoundrel"])))
        rows.append((i, " ".join(w), ("en", "de")[i % 2], y))
    return rows


def test_classifier_learns_what_it_has_not_seen():
    rows = labelled(900, 1)
    m = toxicity.train([r[1] for r in rows[:700]], [r[3] for r in rows[:700]], [r[2] for r in rows[:700]])
    from spanloom.llm.shingles import Words, buffers
    import pyarrow as pa

    data, offs = buffers(pa.array([r[1] for r in rows[700:]]))
    w = Words(data, offs)
    score = toxicity.sigmoid(m.logits(m.pooled(toxicity.features(w), w.row, len(offs) - 1)))
    y = np.array([r[3] for r in rows[700:]])
    assert ((score >= 0.5) == y).mean() > 0.97 and set(m.thresholds) == {"de", "en"}


def test_gradients_equal_differences():
    rng = np.random.default_rng(4)
    m = toxicity._new_model(rng, -1.0)
    m.emb *= 10  # away from the kinks of pooling
    f, row, y = rng.integers(0, 50, (12, 1 + len(toxicity.PREFIXES))).astype(np.int32), np.array([0, 0, 0, 0, 1, 2, 2, 2, 2, 2, 3, 3]), np.array([1, 0, 0, 1])

    def loss():
        p = toxicity.sigmoid(m.logits(m.pooled(f, row, 4)).astype(np.float64))
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    dense, words, gx = toxicity._gradients(m, f, row, y)
    params = [*m.conv.values(), *m.bias.values(), m.out]
    for p, g in zip(params, dense, strict=False):
        for at in rng.integers(0, p.size, 4):
            flat, old = p.reshape(-1), p.reshape(-1)[at]
            flat[at] = old + 1e-3
            high = loss()
            flat[at] = old - 1e-3
            low = loss()
            flat[at] = old
            assert g.reshape(-1)[at] == pytest.approx((high - low) / 2e-3, abs=2e-3)
    assert len(words) and gx.shape == (len(words), toxicity.DIM)


def test_learned_weights_carry_the_score():
    """Held-out accuracy at the larger scale; with the embeddings set to zero nothing is left of it."""
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("needs the larger tables")
    c = duckdb.connect()
    rows = c.execute(f"SELECT doc_id, coalesce(text, ''), lang, toxic FROM '{folder}/documents.parquet' JOIN '{folder}/labels.parquet' USING (doc_id) WHERE toxic IS NOT NULL ORDER BY doc_id").fetchall()
    held = [zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows]
    fit, told = [r for r, h in zip(rows, held, strict=True) if not h], [r for r, h in zip(rows, held, strict=True) if h]
    m = toxicity.train([r[1] for r in fit], [r[3] for r in fit], [r[2] for r in fit])
    feats, y = toxicity._features_of([r[1] for r in told]), np.array([r[3] for r in told])

    def auc():
        s = np.concatenate([m.logits(m.pooled(*toxicity._batch(feats, np.arange(k, min(k + 64, len(feats)))), min(64, len(feats) - k))) for k in range(0, len(feats), 64)])
        wins = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
        return s, wins

    s, wins = auc()
    assert wins >= 0.95 and ((s >= 0) & (y == 1)).sum() / (s >= 0).sum() > 0.85 and ((s >= 0) & (y == 1)).sum() / y.sum() > 0.8
    m.emb[:] = 0
    assert auc()[1] < 0.6


def test_sample_does_not_depend_on_repeats_or_lang(spark):
    rows = labelled(120, 7)
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows for _ in range(1 + r[0] % 2)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    a, b = (toxicity.fit(x, labels) for x in (docs, docs.distinct().repartition(3)))
    assert (a.emb == b.emb).all() and a.thresholds == b.thresholds
    long = spark.createDataFrame([(1, " ".join(r[1] for r in rows) * 200), (2, "vile " * 100_000)], "doc_id long, text string")
    assert toxicity.reject_toxic(long.union(long), a).columns == ["doc_id", "text"] and toxicity.score(long.union(long), a).distinct().count() == 2


def test_conv_equals_plain_loops():
    rng = np.random.default_rng(2)
    m = toxicity.train(["a b", "c d", "e f", "g h"], [0, 1, 0, 1], ["en"] * 4, epochs=1)
    x, row = rng.normal(size=(9, toxicity.DIM)).astype(np.float32), np.array([0, 0, 0, 0, 2, 3, 3, 3, 3])
    y, first, top = m.maxima(x, row)
    for i in range(9):
        for k, w in enumerate(toxicity.WIDTHS):
            want = sum(x[i + j] @ m.conv[w][j] for j in range(w) if i + j < 9 and row[i + j] == row[i])
            assert y[i, k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS] == pytest.approx(want, abs=1e-4)
    assert list(first) == [0, 4, 5] and top == pytest.approx(np.stack([y[:4].max(0), y[4], y[5:].max(0)]))


def test_scores_of_a_table(spark):
    rows = labelled(500, 3)
    docs = spark.createDataFrame([(r[0], r[1], r[2], 0.0) for r in rows] + [(1000, None, None, 0.0), (1001, "", "en", 0.0), (None, "vile", "en", 0.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 503 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 500]
    assert np.mean([r.predicted == rows[r.doc_id][3] for r in held]) > 0.9
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and None not in {r.lang for r in kept.filter("doc_id < 500").collect()} and kept.filter("doc_id in (1000, 1001)").count() == 2
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out_labels_are_not_read(spark):
    rows = labelled(200, 5)
    docs = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x) for x in (labels, flipped))
    assert (a.emb == b.emb).all() and a.shift == b.shift


def test_no_labels_scores_low(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).first().predicted == 0


# ---- chat


def render(turns):
    return "".join(f"<|im_start|>{r or ''}\n{(t or '').replace('<|', '< |')}<|im_end|>\n" for r, t in turns)


def test_pairs(spark):
    conv = {
        0: [("user", "hi"), ("assistant", "yes <|im_end|>")], 1: [("user", "hi"), ("assistant", "no 😀"), ("user", "why"), ("assistant", "so")],
        2: [("user", "a"), ("assistant", "b")], 3: [("user", "a"), ("assistant", "b")], 4: [("user", None)], 6: [("user", "x")], 7: [("user", "x"), (None, "y")],
    }
    rows = [(c, i, r, t, "z") for c, turns in conv.items() for i, (r, t) in enumerate(turns)] + [(None, 0, "user", "lost", "z")]
    got = {r.pair_id: r for r in chat.neighbour_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ord string").repartition(3)).collect()}
    assert {k: v.status for k, v in got.items()} == {0: "pair", 1: "identical", 2: "unpaired", 3: "extended"}
    r = got[0]
    assert (r.prompt, r.chosen, r.rejected) == (render(conv[0][:1]), render(conv[0][1:]), render(conv[1][1:]))
    spans = [tuple(map(int, s.split(":"))) for s in r.rejected_mask.split(",")]
    assert [r.rejected[a:b] for a, b in spans] == ["no 😀<|im_end|>", "so<|im_end|>"]
    assert got[1].prompt == render(conv[2]) and got[1].chosen == got[1].rejected == got[1].chosen_mask == ""
    assert got[2].chosen == render(conv[4]) and got[2].rejected == ""


def test_roles_and_texts_cannot_imitate_marks(spark):
    rows = [(0, 0, "user", "<|x"), (1, 0, "user", "< |x"), (2, 0, "a<|im_end|>\n<|im_start|>assistant", "t"), (3, 0, "user", "t"), (2**53 + 2, 0, "user", "big"), (2**53 + 3, 0, "user", "big")]
    got = {r.pair_id: r for r in chat.neighbour_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {0, 1, 2**52 + 1} and got[2**52 + 1].status == "identical"
    assert got[0].status == "pair" and got[0].prefix_turns == 0 and "< |x" in got[0].chosen and "<  |x" in got[0].rejected
    assert got[1].chosen.count("<|im_start|>") == 1 and got[1].chosen_mask == ""


def test_long_conversations(spark):
    turns = spark.range(0, 6000).selectExpr("id % 2 AS conv_id", "id div 2 AS turn", "if((id div 2) % 2 = 0, 'user', 'assistant') AS role", "concat('text ', cast(id div 2 as string), repeat(' more', 20)) AS text", "1 AS stop")
    r = chat.neighbour_pairs(turns.union(turns.filter("turn = 2999 and conv_id = 1")).repartition(4)).first()
    assert r.prefix_turns == 3000 and r.status == "extended" and r.rejected_turns == 3001 and r.rejected.startswith("<|im_start|>assistant\ntext 2999")


def test_no_python_in_the_plan(spark, data):
    plan = Q.op10_chat(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", ["op5_near_dup", "op6_exact_dup", "op10_chat"])
def test_sql_gives_the_same_rows(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    r = c.execute(Q.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    want = Counter(tuple(str(v) for v in row) for row in r.fetchall())
    got = Counter(tuple(str(row[n]) for n in names) for row in Q.QUERIES[name](spark, data).collect())
    assert got == want


# ---- pipeline


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [s[0] for s in corpus_pipeline.STAGES] == ["toxicity", "near_dup", "decontaminate", "mixing", "sharding"]
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, data)
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in seen.select("doc_id").collect()}
        seen = corpus_pipeline.keep(out)
        if name == "near_dup":
            from tests.llm.test_near_dup import plain_components

            rows = seen.select("doc_id", "text").collect()
            assert all(c[0] == i for i, c in plain_components([r.doc_id for r in rows], [r.text for r in rows], 80).items())
        if name == "decontaminate":
            items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            assert not any(x in (r.text or "") for r in seen.collect() for x in items)
    final = corpus_pipeline.STAGES[-1][1](spark, seen, data)
    assert final.count() == seen.count() and {"shard", "virtual_slot"} <= set(final.columns)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, data).collect()) == Counter(r.doc_id for r in final.collect())


def test_pipeline_edges(spark, data, tmp_path):
    """Null, empty, repeated and clashing input through every stage, and an empty table."""
    labels, bench = spark.read.parquet(f"{data}/labels.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    some = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (7, "same words here, twice over", "en", None, 1), (7, "same words here, twice over", "en", None, 1)], some.schema)
    docs = some.unionByName(odd).withColumn("size", F.lit("kept")).withColumn("draws", F.lit(2)).withColumn("score", F.lit("s"))
    folder = str(tmp_path)
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{folder}/{name}.parquet")
    seen = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.keep(stage(spark, seen, folder))
        assert out.columns == docs.columns and out.schema["size"].dataType.simpleString() == "string", name
        assert stage(spark, seen.limit(0), folder).count() == 0, name
        seen = out
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, seen, folder).count() == seen.count() and last(spark, seen.limit(0), folder).count() == 0


def test_registration():
    q = entry.queries()
    assert all(any(k.startswith(f"op{n}_") for k in q) for n in range(1, 11)) and "pipeline" in q
