"""Main text of pages: parts named and hidden, whole pages with known articles, sharded suffix arrays; vectors of any size."""

import random
import re
from collections import Counter

import numpy as np

from groundset.llm import embedding_dedup, html_text


def main(page):
    return html_text.blocks(page)[0]


def test_parts_of_an_article_by_their_names():
    assert main('<article><div class="notice-box">Sale</div><div class="adbox">buy</div><div class="ad-slot">x</div><p>Text</p></article>') == ["Text"]
    assert main('<article><section class="social-policy"><p>On policy</p></section><p class="share-prices">Prices rose</p><p class="notice">gone</p></article>') == ["On policy", "Prices rose"]
    assert main('<article><div class="social">a</div><div class="social-links">b</div><ul class="post-share"><li>c</ul><div class="share-buttons bottom">d</div><p>e</p></article>') == ["e"]
    assert main('<article><h2 class="search">Search methods</h2><p>Text</p><div class="search">box</div></article>') == ["Search methods", "Text"]


def test_hidden_parts_and_main_by_role():
    assert main('<article><p hidden>no</p><div style="color:red; display: none">no <p>no</p></div><p>Text <span hidden>no</span> goes on</p><p class="not hidden here">stays</p></article>') == ["Text", "goes on", "stays"]
    assert main('<body><div>menu</div><div role="main"><p>Text</p><nav>x</nav></div><div>foot</div>') == ["Text"]


def test_whole_pages_give_their_articles(spark):
    """Pages put together from known article blocks and everything that doesn't belong to them, all rows and texts of them."""
    random.seed(21)
    words = [f"word{i}" for i in range(400)] + ["é&amp;à", "1 &lt; 2", "\U0001f600"]
    plain = lambda t: re.sub(r"\s+", " ", t.replace("&amp;", "&").replace("&lt;", "<")).strip()
    rows, want = [], {}
    for i in range(60):
        blocks = [" ".join(random.choices(words, k=random.choice((1, 5, 40, 3000 if i % 20 == 0 else 9)))) for _ in range(random.randrange(6))]
        body = "".join(random.choice((f"<p>{b}</p>", f"<p>{b}", f"<h2>{b}</h2>", f"<ul><li>{b}</ul>", f"<div class=lead><p>{b}</p></div>")) + random.choice(("", "<script>var x = '<p>no</p>'</script>", "<aside>also</aside>", '<div class="adbox">buy</div>', "<!-- <p>no</p> -->", "<form><input>send</form>")) for b in blocks)
        page = f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>{random.choice(('<article>{}</article>', '<main>{}</main>', '<div role=main>{}</div>')).format(body)}<div class=comments><p>first!</p></div><footer>&copy; us</footer></body></html>"
        rows.append((i, f"http://h{i % 3}.org/{i}", page))
        want[i] = " ".join(plain(b) for b in blocks)
    rows += [(100, None, None), (101, "http://h0.org/", ""), (0, *rows[0][1:])]
    got = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter([(i, t) for i, t in want.items()] + [(100, ""), (101, ""), (0, want[0])])
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sharded_suffix_arrays_equal_the_one_of_the_host(spark):
    """Stretches that overlap, shards of few of them, anchors with too many: all give the runs of the whole host's suffix array."""
    random.seed(22)
    parts = [" ".join(random.choices("abcdefgh", k=random.choice((6, 9, 14, 30)))) for _ in range(14)]
    texts = {" ".join(random.choice(parts) if random.random() < 0.6 else f"own{i}x{k}" for k in range(9)) for i in range(120)}
    pages = [(i, "h", t) for i, t in enumerate(sorted(texts))]
    want = {i: set(np.flatnonzero(b)) for (i, _, t), b in zip(pages, html_text.shared_runs([p[2].split(" ") for p in pages], [p[0] for p in pages]))}
    df = spark.createDataFrame(pages, "_page long, _host string, open string").repartition(3)
    before = html_text.SHARD, html_text.GROUP
    try:
        for html_text.SHARD, html_text.GROUP in ((4_000, 4_000), (5, 4_000), (5, 2)):
            got = {r._page: set(r.starts) for r in html_text.repeated_starts(df).collect()}
            assert got == {i: s for i, s in want.items() if s}
    finally:
        html_text.SHARD, html_text.GROUP = before


def test_very_small_and_very_large_vectors_link(spark):
    base = [[1.0, 2.0, 3.0], [3.0, -1.0, 0.5]]
    rows = [(i, [x * scale for x in base[i % 2]]) for i, scale in enumerate((1.0, 1.0, 1e-200, 1e-200, 1e200, 1e250, 5e-310, 1e-310))] + [(8, [0.0, 0.0, 0.0]), (9, None), (10, [1e-200, float("nan"), 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (3, i % 2, i < 2) for i in range(8)} | {i: (0, i, True) for i in (8, 9, 10)}


def test_links_of_many_vectors_against_all_pairs(spark):
    """A table with links: chains, stars and pairs on both sides of the threshold."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 24))
    for i in range(0, 600, 3):
        for j, angle in ((i + 1, 0.28), (i + 2, 0.31 if i % 2 else 0.36)):
            away = rng.normal(size=24)
            away -= away @ x[i] / (x[i] @ x[i]) * x[i]
            x[j] = x[i] / np.linalg.norm(x[i]) * np.cos(angle) + away / np.linalg.norm(away) * np.sin(angle)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_groups(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] <= near[i].sum() for i in got) and sum(got.values()) >= 0.97 * near.sum() and near.sum() > 400
