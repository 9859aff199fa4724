"""Operators 11 to 13 against brute force on small fixtures, and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.llm import centroids, html_article, lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    """Brute force of the scoring."""
    docs = [(i, terms(t)) for i, t in docs]
    docs = [d for d in docs if d[1]]
    n, total = len(docs), sum(len(t) for _, t in docs)
    out = []
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    for item, own in wanted.items():
        scored = []
        for i, t in docs:
            m, score = 10 + 90 * len(t) * n // total, 0
            for term in own:
                tf, df = t.count(term), sum(term in x for _, x in docs)
                if tf:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    r = np.random.default_rng(3)
    vocab = [*("".join(r.choice(list("abcdeé9"), size=r.integers(1, 5))) for _ in range(150)), "The", "THE", "ÄÖ", "äö"]
    texts = [" ".join(r.choice(vocab, size=int(n))) for n in r.integers(1, 60, size=150)]
    texts += [texts[3]] * 15 + [None, "", " -.- ", "x", "a" * 5000, "the-THE_The", ("long word " * 3000).strip(), "一二 three"]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, texts[3]), (None, texts[3])]


ITEMS = [(1, "abc The äö e9 one three"), (2, None), (3, "..."), (4, "long word x"), (5, "a b c d e é 9"), (5, "ab ac"), (None, "the 一二"), (7, "zzzz nowhere")]


@pytest.mark.parametrize(("shard", "most", "k"), [(1 << 20, 1 << 18, 10), (200, 4, 10), (50, 1 << 18, 3)])
def test_search_is_the_brute_force_ranking(spark, corpus, shard, most, k):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = lexical_search.search(lexical_search.build_index(docs, shard=shard), items, k, most=most)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == ranked(corpus, ITEMS, k)
    assert {r[0] for r in got} == {1, 4, 5, None}


def test_terms_are_hashed_alike_in_pieces(corpus):
    import pyarrow as pa

    texts = pa.array([t for _, t in corpus], pa.string())
    h, owner = lexical_search.term_hashes(texts)
    again, same = lexical_search.term_hashes(texts, piece=16)
    assert (h == again).all() and (owner == same).all()
    flat = [(k, t) for k, (_, x) in enumerate(corpus) for t in terms(x)]
    assert owner.tolist() == [k for k, _ in flat]
    assert len(set(h.tolist())) == len({t for _, t in flat})


def test_ties_at_the_last_place_go_to_the_first():
    score = np.array([5, 0, 9, 5, 5, 7, -1])
    assert lexical_search.best_places(score, 3).tolist() == [0, 2, 5]
    assert lexical_search.best_places(score, 4).tolist() == [0, 2, 3, 5]
    assert lexical_search.best_places(np.zeros(9, int), 2).tolist() == []


def test_search_of_empty_tables(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, text string, score long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(none), items).count() == 0
    docs = spark.createDataFrame([(*r, 1, "a") for r in corpus], "doc_id long, text string, rank int, item_id string")
    assert lexical_search.search(lexical_search.build_index(docs), none.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert lexical_search.search(lexical_search.build_index(docs), items).columns == ["item_id", "rank", "doc_id", "score"]


def lloyd(rows, k, rounds):
    """Plain integer k-means. rows: (vec_id, ints)."""
    x = np.array([v for _, v in rows], dtype=object)
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"3:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    c = [list(rows[i][1]) for i in order[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for v in x]

    for _ in range(rounds):
        own = nearest()
        for j in range(len(c)):
            members = [v for v, (_, n) in zip(x, own, strict=True) if n == j]
            if members:
                c[j] = [sum(m[i] for m in members) // len(members) for i in range(len(c[j]))]
    own = nearest()
    per = [sum(d for d, n in own if n == j) for j in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, n, d, per[n], sum(per), digest[n]) for (i, _), (d, n) in zip(rows, own, strict=True)), key=str)


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_bounds_change_nothing(spark, kind):
    r = np.random.default_rng(5)
    if kind == "spread":
        v = np.concatenate([r.normal(m, 1, (40, 64)) for m in r.normal(0, 1.5, (9, 64))])
    elif kind == "ties":
        v = r.integers(-1, 2, (200, 64)) * (np.arange(64) < 3) / 4.0
    else:
        v = r.normal(0, 1, (5, 64))
    rows = [(i if i % 50 else None, x.tolist()) for i, x in enumerate(v.astype(np.float32))]
    rows += rows[1:4]
    odd = [(900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [1e30] * 64), (906, [])]
    table = spark.createDataFrame([(*x, "c") for x in rows + odd], "vec_id long, embedding array<float>, cluster string").repartition(3)
    got = sorted((tuple(x) for x in centroids.clustered(table).collect()), key=str)
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    assert got == lloyd(ints, 8, 10)


def test_bounds_hold_and_spare_scans():
    r = np.random.default_rng(7)
    x = np.concatenate([r.integers(-20, 20, (300, 8)) + m for m in r.integers(-900, 900, (6, 8))]).astype(np.int64)
    old = x[r.choice(len(x), 6, replace=False)].copy()
    cluster, upper, lower = centroids._scan(x, old)
    spared = 0
    for _ in range(6):
        new = np.array([x[cluster == j].sum(axis=0) // max((cluster == j).sum(), 1) if (cluster == j).any() else old[j] for j in range(6)])
        cluster, upper, lower, scans = centroids.step(x, cluster, upper, lower, old, new)
        d = centroids.squared(x, new)
        assert (cluster == d.argmin(axis=1)).all()
        own = np.sqrt(d[np.arange(len(x)), cluster])
        d[np.arange(len(x)), cluster] = np.iinfo(np.int64).max
        assert (upper >= own).all() and (lower <= np.sqrt(d.min(axis=1))).all()
        spared += len(x) - scans
        old = new
    assert spared > len(x)


def test_clusters_of_an_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    out = centroids.clustered(none)
    assert out.count() == 0
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


SAY = "The quick brown fox jumps over the lazy dog, and then it runs away from here."
SHAPES = {
    "main": ('<body class="has-sidebar"><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><main><h1>Title</h1>{0}<ul><li>one</li><li>two</li></ul></main><aside><p>aside said</p></aside><footer>foot</footer></body>', "Title\n\n{1}\n\none\n\ntwo"),
    "div": ('<div id="wrapper"><div class="top-menu"><ul><li><a href="#">A</a><li><a href="#">B</a></ul></div><div id="content"><h2>Head</h2><div class="post-{2}">{0}</div></div><div id="comments"><h3>Comments</h3><div class="comment"><p>I say so myself, at length, as ever.</p></div></div><div class="cookie-notice">We use cookies</div><div>Plain end 2020</div></div>', "Head\n\n{1}"),
    "header": ('<body><article class="post"><header class="entry-header"><div><h1>Headline</h1></div><p>By someone</p></header>{0}<form><input><p>Subscribe now</p></form><section class="related"><a href=q>More</a></section><footer>Posted in</footer></article><section id="comments"><article class="comment"><p>Long talk here, and more of it, without an end in sight.</p></article></section></body>', "Headline\n\n{1}"),
    "script": ('<head><title>No</title></head><body><div role="alert">Mind</div><article>{0}<script>if (a<b) document.write("<p>evil</p>")</script><style>p{{}}</style><noscript>no</noscript><!-- x <p>c</p> --><table><tr><td>c1<td>c2</table></article>', "{1}\n\nc1\n\nc2"),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_articles_are_found_in_pages_of_a_host(spark, shape):
    """Paragraphs of many lengths; the host's pages agree on the container, also where a page alone would not show it."""
    form, want = SHAPES[shape]
    r = np.random.default_rng(11)
    rows, expect = [], {}
    for i in range(30):
        said = [f"{SAY} {i}.{k}" if r.random() < 0.8 else "Yes." for k in range(int(r.integers(1, 6)))]
        rows.append((i, f"http://www.Host.example/{i}", "<html>" + form.format("".join(f"<p>{s}<br>" for s in said), "", i)))
        expect[i] = want.format("", "\n\n".join(said))
    got = {x.page_id: x for x in html_article.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: x.text for i, x in got.items()} == expect
    assert all(x.n_chars == len(x.text) for x in got.values())


def test_a_host_outvotes_a_page(spark):
    """One page whose unnamed side column is longer than its text: alone it errs, with its host it does not."""
    page = '<body><div class="text"><h1>T</h1><p>{}</p></div><div class="col"><p>{}</p></div></body>'
    rows = [(i, "http://h.example/", page.format(SAY * 3, "Short note.")) for i in range(9)] + [(9, "http://h.example/", page.format(SAY, "More in this column. " * 20))]
    rows += [(10, "http://alone.example/", rows[9][2])]
    got = {x.page_id: x.text for x in html_article.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == f"T\n\n{SAY}"
    assert got[10] != got[9]


def test_many_hosts_are_joined_by_salt(spark):
    rows = [(i, f"http://h{i % 7}.example/", f"<article><p>{SAY} {i}</p></article>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, html_article.extract(pages, most=3).collect())) == sorted(map(tuple, html_article.extract(pages).collect()))


def test_awkward_pages(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    cases = {None: "", "": "", "plain &amp; simple": "plain & simple", "<nav><a href=x>Home</a></nav>": "", "<p>a&nbsp;b &#39;c&#x27; &unknown; &am": "a b 'c' &unknown; &am", f"<article><p>{SAY}<script>never ends <p>x": SAY, "<article><p>one <a href='x'>two</a><p>three": "one two\n\nthree", deep: "deep text", "<!-- open": "", "<article><p>x < y and <3</article>": "x < y and <3", "<p>" + "word " * 50000: " ".join(["word"] * 50000)}
    rows = [(i, None if i % 2 else f"http://h{i}/", h, "x") for i, h in enumerate(cases)]
    got = {x.page_id: x.text for x in html_article.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_article.extract(none).count() == 0
    twice = spark.createDataFrame([(1, "u", "<p>t</p>")] * 2 + [(None, "u", "<p>t</p>")], "page_id long, url string, html string")
    assert html_article.extract(twice).groupBy("page_id", "text").count().orderBy(F.desc("count")).collect()[0] == (1, "t", 2)
