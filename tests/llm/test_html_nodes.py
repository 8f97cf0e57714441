"""Lists, tables, code and quotations of articles, names that are no boilerplate, and the score told plainly."""

import random

import pytest

from spanloom.llm import html_text as H

P = "This is a long paragraph of the article, with some commas, and a good number of words in it, so that nobody doubts it. It goes on, as such paragraphs do."
SHORT = {
    "table": "<table>" + "".join("<tr>" + "".join(f"<td>c{r}x{c}</td>" for c in range(4)) + "</tr>" for r in range(6)) + "</table>",
    "list": "<ul>" + "".join(f"<li>item {i}</li>" for i in range(12)) + "</ul>",
    "terms": "<dl>" + "".join(f"<dt>t{i}</dt><dd>d{i}</dd>" for i in range(12)) + "</dl>",
    "code": "".join(f"<div>x = {i}</div>" for i in range(15)),
    "quotes": "".join(f"<blockquote>Q{i} said</blockquote>" for i in range(10)),
    "quoted paragraphs": "".join(f"<blockquote><p>Q{i} said</p></blockquote>" for i in range(10)),
    "heading": '<h2 id="login">How to log in</h2>',
    "section": f'<section id="consent"><p>{P} Of consent.</p></section>',
    "linked list": "<ul>" + "".join(f"<li><a href=x>source {i}</a></li>" for i in range(8)) + "</ul>",
    "preformatted": "<pre>a = 1\nb = 2</pre>",
}


@pytest.mark.parametrize("place", ["middle", "end"])
@pytest.mark.parametrize("form", ["<article>{}</article>", "<main>{}</main>", "{}"])
@pytest.mark.parametrize("name", SHORT)
def test_short_parts_of_articles_stay(name, form, place):
    if (name, form, place) == ("linked list", "{}", "end"):
        pytest.skip("links at the end of a page that marks no article are a menu")
    parts = [f"<p>{P} {i}</p>" for i in range(3)]
    parts.insert(2 if place == "middle" else 3, SHORT[name])
    body = "".join(parts)
    page = f"<html><body><nav><ul><li><a href=a>Home</a></li></ul></nav>{form.format(body)}<footer>Copyright of all</footer></body></html>"
    want = [t for b in H.blocks(body) if (t := " ".join("".join(b.text).split()))]
    assert H.main_blocks(page) == want


@pytest.mark.parametrize("form", ["<article>{}</article>", "{}"])
@pytest.mark.parametrize(
    "junk",
    ['<div id="comments"><p>{p}</p></div>', '<div class="ad">Buy, now, it is cheap.</div>', '<ul class="share"><li><a href=x>Post</a></li><li><a href=y>Mail</a></li></ul>', '<div id="cookies">We use cookies.</div>', "<form><p>{p}</p></form>"],
)
def test_boilerplate_still_goes(form, junk):
    body = f"<p>{P} one</p><p>{P} two</p>{junk.format(p=P)}<p>{P} three</p>"
    assert H.main_blocks(form.format(body)) == [f"{P} {n}" for n in ("one", "two", "three")]


def test_a_table_that_lays_out_a_page_is_no_node():
    page = f"<table><tr><td><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></td><td><p>{P} one</p><p>{P} two</p></td></tr></table>"
    assert H.main_blocks(page) == [f"{P} one", f"{P} two"]


def test_scores_equal_plain_ones():
    """Ratios by path, smoothing and fusion, node by node from their definition."""
    rng = random.Random(3)
    for _ in range(200):
        nodes = []
        for _ in range(rng.randint(1, 12)):
            x = H.Node(rng.randrange(4), 0, rng.choice([H.PLAIN, H.PLAIN, H.CALLED, H.DOUBTFUL]), rng.random() < 0.2)
            x.length, x.punct = rng.randint(1, 300), rng.randint(0, 9)
            x.linked = rng.choice([0, 0, x.length // 2, x.length])
            nodes.append(x)
        marked = rng.random() < 0.5

        def mean(path, field, nodes=nodes):
            same = [getattr(x, field) for x in nodes if x.path == path]
            return sum(same) / len(same)

        plain = [x.path for x in nodes if not x.whole] or [x.path for x in nodes]
        top = {f: max(mean(p, f) for p in plain) for f in ("length", "punct")}
        own = [sum(0.5 * min(1.0, mean(x.path, f) / (top[f] or 1.0)) for f in top) for x in nodes]
        want = []
        for i, x in enumerate(nodes):
            near = own[max(0, i - 1) : i + 2]
            share = mean(x.path, "linked") / mean(x.path, "length")
            doubt, links = (0.35, 0.5) if marked else (0.15, 1.0)
            if x.rank == H.PLAIN:
                want.append(sum(near) / len(near) * (1 - links * share))
            else:
                want.append(own[i] * (0.35 if x.rank == H.CALLED else doubt) * (1 - share))
        assert H.scores(nodes, marked) == pytest.approx(want)
