import html
import re

import numpy as np
import pytest

from cloudsieve.llm import html_trees as H


def test_held_out_pages():
    model = H.trained()
    pages = [H.Page(p) for p in H.labelled_pages(120, seed=99)]
    right = [p.text(p.article(H.chances(model, p.features()))) == p.text(p.marked) for p in pages]
    assert np.mean(right) > 0.97


def test_given_pages(spark, small):
    from cloudsieve.llm.queries import QUERIES

    def truth(source):
        blocks = re.split("</?(?:p|h1)>", re.search("<article>(.*?)</article>", source, re.S)[1])
        texts = [re.sub("[\x20\x09-\x0d]+", " ", html.unescape(re.sub("</?b>", "", b).replace("<br>", " "))).strip(" ") for b in blocks]
        return "\n".join(t for t in texts if t)
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = QUERIES["op8_html_trees"](spark, small).collect()
    assert len(got) == len(sources) and all(r.text == truth(sources[r.page_id]) and r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("source,text", [
    ("<nav><a href='/'>home</a></nav><article><h1>T &amp; t</h1><p>one <b>two</b>,\n three.<br>four &eacute;<p>five. six.<aside class=ad>buy</aside></article><footer>f</footer>",
     "T & t\none two, three. four é\nfive. six."),
    ("<body><div id='cookie-notice'><p>We use cookies.</p></div><div class='post-content'><p>First text, long enough to be read. Really.</p><ul><li>a, b.<li>c.</ul>"
     "</div><div class='comments'><p>Nice, thanks. I liked it.</p></div></body>", "First text, long enough to be read. Really.\na, b.\nc."),
])
def test_pages(source, text):
    assert H.main_texts([source], H.trained()) == [text]


def test_malformed_and_odd_sources():
    odd = ["", "plain  text\nonly &lt;", "<", "<p", "<p>a<script>var x='</p>'", "<!-- <p>a</p>", "<a href=\"x>y", "</p></div>", "<p>" * 3000, "&#xZZ;&#0;"]
    got = H.main_texts(odd, H.trained())
    assert len(got) == len(odd) and got[0] == "" and got[1] == "plain text only <"


def test_labels_never_contradict():
    rng = np.random.default_rng(6)
    for source in H.labelled_pages(10, seed=5):
        page = H.Page(source)
        chosen = page.article(rng.random(len(page.tags)))
        for i in range(1, len(page.tags)):
            up, path = page.parent[i], []
            while up >= 0:
                path.append(chosen[up])
                up = page.parent[up]
            # once the article is left on a branch it is not entered again
            if chosen[i] and True in path:
                assert path[0]


def test_best_labelling_by_enumeration():
    page = H.Page("<div><p>a<b>b</b></p><i>c</i></div>")
    rng = np.random.default_rng(1)
    n = len(page.tags)
    for _ in range(30):
        c = rng.random(n)
        best = None
        for code in range(3 ** n):
            s = [code // 3 ** i % 3 for i in range(n)]
            if s[0] == 2 or any((s[page.parent[i]], s[i]) in ((0, 2), (1, 0), (2, 0), (2, 1)) for i in range(1, n)):
                continue
            value = sum(np.log(c[i]) if s[i] == 1 else np.log1p(-c[i]) for i in range(n))
            if best is None or value > best[0] + 1e-12:
                best = value, [x == 1 for x in s]
        chosen = page.article(c)
        value = sum(np.log(c[i]) if chosen[i] else np.log1p(-c[i]) for i in range(n))
        assert value == pytest.approx(best[0])


def test_awkward_rows(spark):
    rows = [(1, None, None, "t"), (2, "u", "", "t"), (2, "u", "", "t"), (None, "u", "<article><p>Text, here.</p></article>", "t"), (4, "u", "x" * 200_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(pages)
    assert got.columns == ["page_id", "url", "html", "text"]
    assert sorted(len(r.text) for r in got.collect()) == [0, 0, 0, 11, 200_000]
    assert H.extract(pages.limit(0)).count() == 0


def test_nesting_and_stray_end_tags_cost_linear_time():
    import time
    n = 100_000
    at = time.monotonic()
    page = H.Page("<div>" * n + "deep" + "</span>" * n + "</b></p>" * n + "end" + "</div>" * n + "after")
    assert time.monotonic() - at < 4
    assert len(page.tags) == n + 1
    assert ["".join(t for _, t in b) for b in page.blocks] == ["deep", "end", "after"]
