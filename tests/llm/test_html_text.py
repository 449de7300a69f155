"""Main texts of pages, against a plain version that compares all pages of a host."""

import numpy as np
import pytest

from clickloom.llm import exchange, html_text

from .tables import sentence

SCHEMA = "page_id long, url string, html string, text string, host string, kinds string"


def pages_of(spark, rows):
    """Pages with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def test_html_text(spark):
    page = (
        "<!doctype html><html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav>"
        "<article><h1>Head &amp; more</h1><p>One <b>two</b><br>three&nbsp; four</p><div class='advert'>Buy</div><p>&lt;b&gt; &#233;</p>"
        "<form>Name</form><section id=comments><p>nice</p></section></article><footer>&copy; x</footer></body></html>"
    )
    rows = [(1, "http://a.example/1", page), (2, None, None), (3, "http://a.example/3", ""), (4, "http://a.example/4", "<article><p>cut <a href='x"), (1, "http://a.example/1", page)]
    got = html_text.html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == sorted(
        [(1, "Head & more\nOne two three four\n<b> é", 36), (2, "", 0), (3, "", 0), (4, "cut", 3), (1, "Head & more\nOne two three four\n<b> é", 36)]
    )


def plain(rows, repeat=6, template=0.3, least_pages=4, covered=0.9):
    """Every window of every page of a host, counted by distinct texts."""
    parsed = {}
    for i, (_, url, page) in enumerate(rows):
        parsed[i] = (url.split("/")[2], [(k, t) for k, t in html_text.blocks(page) if k != html_text.DECLARED])
    tokens = {i: " ".join(t for _, t in found).split(" ") if found else [] for i, (_, found) in parsed.items()}
    texts = []
    for i, (host, found) in parsed.items():
        distinct = {"\n".join(t for _, t in other): tokens[j] for j, (h, other) in parsed.items() if h == host}
        runs = [{tuple(w[at : at + repeat]) for at in range(len(w) - repeat + 1)} for w in distinct.values()]

        def share(least, found=found, w=tokens[i], runs=runs):
            inside = [False] * len(w)
            for at in range(len(w) - repeat + 1):
                if sum(tuple(w[at : at + repeat]) in r for r in runs) >= least:
                    inside[at : at + repeat] = [True] * repeat
            at, out = 0, []
            for _, t in found:
                n = len(t.split(" "))
                out.append(sum(inside[at : at + n]) / n)
                at += n
            return out

        size = lambda t: len(t.split(" "))
        apart = sum(size(t) for (k, t), x in zip(found, share(2)) if k == html_text.OPEN and x < 0.5)
        if 0 < (every := sum(size(t) for k, t in found if k == html_text.ARTICLE)) >= apart:
            article = [(t, x) for (k, t), x in zip(found, share(max(least_pages, template * len(distinct)))) if k == html_text.ARTICLE]
            gone = sum(size(t) for t, x in article if x >= covered)
            keep_all = 2 * gone >= every
            texts.append("\n".join(t for t, x in article if keep_all or x < covered))
        else:
            unique = [t for (_, t), x in zip(found, share(2)) if x < 0.5]
            texts.append("\n".join(unique or [t for _, t in found if len(t.split(" ")) >= 10] or [t for _, t in found]))
    return texts


SHARED = "Subscribe to our daily letter and never miss another story again"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    found = []
    for i in range(60):
        host, own = f"h{i % 3}.example", [f"<p>{sentence(rng, int(n))}</p>" for n in rng.integers(3, 40, 3)]
        shared = f"<p>{SHARED}</p>" if i % 3 == 0 else ""
        if i % 3 == 1:
            found.append((i, f"http://{host}/{i}", f"<body><div>{SHARED} on this host</div>{''.join(own)}</body>"))
        else:
            found.append((i, f"http://{host}/{i}", f"<body><article>{own[0]}{shared}{own[1]}{own[2]}</article></body>"))
    found += [(100 + i, f"http://h2.example/copy{i}", found[2][2]) for i in range(12)]  # copies of one article
    return [*found, (200, "http://h1.example/none", "<body></body>"), (201, "http://h1.example/same", found[1][2])]


def test_against_all_pairs(spark, rows):
    expected = {r[0]: t for r, t in zip(rows, plain(rows))}
    for options in ({}, {"block_bytes": 2000, "range_keys": 50}):
        got = html_text.html_text(pages_of(spark, rows), **options).collect()
        assert {r["page_id"]: r["text"] for r in got} == expected and len(got) == len(rows)
    # the array decides: within declared articles, and where none is declared
    assert all(SHARED not in expected[i] for i in range(60) if i % 3 < 2)
    assert len({expected[100 + i] for i in range(12)} | {expected[2]}) == 1 and expected[2].count("\n") == 2


def test_a_host_of_copies_keeps_its_articles(spark):
    page = "<article><p>The very same words stand on all of the pages of this host today</p></article>"
    near = [page.replace("today", f"number {i}") for i in range(20)]
    got = html_text.html_text(pages_of(spark, [(i, "http://a/", p) for i, p in enumerate([page] * 5 + near)])).collect()
    assert len(got) == 25 and all(r["text"].startswith("The very same words") for r in got)


def test_main_text_beside_a_teaser_stays(spark):
    main = "<p>The long main text of this page stands in no article</p>"
    odd = [
        (1, "http://t1/", f"<article class='teaser'><p>Teaser</p></article><div id='main'>{main}</div>"),
        (2, "http://t2/", f"<article><p>{main}{main}</p></article><div>Some words beside it</div>"),
        (3, "http://t3/", "<article><p class='copyright'>Body on copyright law</p><div class='banner-story'>A story on banners</div></article>"),
        (4, "http://t4/", "<div class='copyright'>All rights</div><p>words</p><div class='banner-story'>A story on banners</div>"),
    ]
    shared = "<div>These very same words stand on each page of this host beside the article</div>"
    teasers = [(10 + i, "http://u/", f"<article><p>Teaser {i}</p></article>{shared}<p>{main} number {i} with words of its own that no other page of it has</p>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_text.html_text(pages_of(spark, odd + teasers)).collect()}
    assert got[1] == "Teaser\nThe long main text of this page stands in no article" and "beside" not in got[2]
    assert got[3] == "Body on copyright law\nA story on banners" and got[4] == "words\nA story on banners"
    expected = {r[0]: t for r, t in zip(odd + teasers, plain(odd + teasers))}
    assert got == expected and all("beside the article" not in got[10 + i] for i in range(6))


def test_no_table_is_left_and_buckets_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(exchange, "MOST_BUCKETS", 3)
    before = {t.name for t in spark.catalog.listTables()}
    rows = [(i, f"http://h{i % 4}/", f"<p>{'page ' * (i % 7)} {i}</p>") for i in range(40)]
    got = html_text.html_text(pages_of(spark, rows), block_bytes=40).collect()
    assert len(got) == 40 and {t.name for t in spark.catalog.listTables()} == before


def test_messages_cut_keys_into_ranges():
    rng = np.random.default_rng(4)
    for bits, ranges in ((64, 1), (64, 7), (44, 1000), (40, 1)):
        keys = np.unique(rng.integers(0, 1 << bits, 500, np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 2**64, 500, np.uint64))
        width, found = -(-(1 << bits) // ranges), []
        for _, r, _, n, steps, counts, _ in exchange.messages(1, 2, keys, np.arange(len(keys)), None, bits, ranges):
            part = np.cumsum(exchange.from_bytes(steps, n))
            assert n and all(int(k) // width == r for k in part)
            found += part.tolist()
        assert found == keys.tolist()
    assert not [*exchange.messages(1, 2, keys[:0], keys[:0], None, 40, 5)]


def test_names_of_parts():
    kinds = lambda page: [k for k, _ in html_text.blocks(page)]
    for name in ("search", "search-box", "share-buttons", "notice", "alert alert-info", "related-posts", "cookie-notice", "site-footer", "banner", "cookie-banner", "copyright"):
        assert kinds(f"<div class='{name}'>words</div>") == [html_text.DECLARED], name
    for name in ("search-results", "share-price", "research", "noticeable", "content", "banner-story", "copyright-law"):
        assert kinds(f"<div class='{name}'>words</div>") == [html_text.OPEN], name


def test_empty_table_and_long_page(spark):
    assert html_text.html_text(pages_of(spark, []).where("page_id > 0")).count() == 0
    page = "<article>" + "<p>word after word stands here</p>" * 40_000 + "</article>"
    row = html_text.html_text(pages_of(spark, [(1, "http://a/", page)])).collect()[0]
    assert row["n_chars"] == 40_000 * 28 - 1 and row["text"].count("\n") == 39_999
