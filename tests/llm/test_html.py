import random
import re
from collections import Counter
from html import unescape

import pytest

from daycast.llm import html, queries
from daycast.llm.common import table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, text string, host string, row long, n string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 1, "z") for i, u, h in rows], SCHEMA)


def texts(spark, rows):
    return {r.page_id: r.text for r in html.extract(pages(spark, rows)).collect()}


def test_article_without_its_surroundings(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{x:y}</style></head><body>
    <header><a href=/>Site</a></header><nav><ul><li>Home</ul></nav><div id="cookie-notice">We use cookies</div>
    <article><header><h1>Big &amp; bold &lt;tag&gt;</h1></header><p>One <b>two</b>
    <i>three</i>&nbsp;four<p>Five &eacute;&#233;&#x1F600;<div class="share-buttons">Share</div>
    <ul><li>a<li>b <span class="ad">buy</span>c</ul><table><tr><td>1<td>2</table>
    <form><label>Name</label><input></form><aside>More</aside><script>var s="</p>";</script>
    <section class="comments"><p>First!</p></section><p class="x">last <!-- no --> 2 < 3</article>
    <div class="sidebar">Side</div><footer>Foot</footer>"""
    assert texts(spark, [(1, "http://a.b/c", page)])[1] == (
        "Big & bold <tag>\nOne two three four\nFive éé😀\na\nb c\n1\n2\nlast 2 < 3")


def test_templates_go_where_there_is_no_article(spark):
    rows = [(k, f"https://u@News.Example.com:80/p{k}?q=1", f"<div>Top story menu<p>More of it</div><div><p>Text {k}</div>"
             f"<div>Made by us</div>") for k in range(5)]
    rows += [(9, "http://other.org/", "<div>Made by us</div><p>Own words</p>")]
    got = texts(spark, rows)
    assert [got[k] for k in range(5)] == [f"Text {k}" for k in range(5)]
    assert got[9] == "Made by us\nOwn words"


def test_recurring_boxes_of_articles_go(spark):
    rows = [(k, "http://x.y/", f"<article><p>Same words</p><div>Read our <b>letter</b></div><p>Own {k}</p></article>")
            for k in range(4)]
    assert texts(spark, rows) == {k: f"Same words\nOwn {k}" for k in range(4)}


@pytest.mark.parametrize("place", ["begin", "third", "end", "last but one"])
def test_a_notice_in_the_articles_of_a_site_goes(spark, place):
    """Wherever its fixed place is, on hosts of any size, without a telling class."""
    rng = random.Random(4)
    rows, want = [], {}
    for h, n in (("a.b", 12), ("c.d", 40), ("e.f", 7)):
        for k in range(n):
            own = [f"Words {h} {k} {j}" for j in range(rng.randrange(3, 9))]
            at = {"begin": 0, "third": 2, "end": len(own), "last but one": len(own) - 1}[place]
            page = own[:at] + ["Follow us on our channel for more stories"] + own[at:]
            key = len(rows)
            rows.append((key, f"http://{h}/{k}", "<article>" + "".join(f"<p>{t}</p>" for t in page) + "</article>"))
            want[key] = "\n".join(own if h != "e.f" else page)       # on too few pages to tell
    assert texts(spark, rows) == want


def test_sentences_written_twice_and_near_copies_stay(spark):
    rng = random.Random(5)
    rows, want = [], {}

    def add(host, blocks):
        want[len(rows)] = "\n".join(blocks)
        rows.append((len(rows), f"http://{host}/", "<article>" + "".join(f"<p>{t}</p>" for t in blocks) + "</article>"))
    for k in range(60):                                    # one sentence in many articles, anywhere
        own = [f"Words {k} {j}" for j in range(rng.randrange(6, 12))]
        own.insert(rng.randrange(len(own) + 1), "It was a long day.")
        add("a.b", own)
    for k in range(30):                                    # an article with another paragraph each time
        own = [f"Common paragraph {j}" for j in range(10)]
        own[rng.randrange(10)] = f"Changed {k}"
        add("c.d", own)
    for k in range(20):                                    # its exact copies
        add("g.h", [f"Copied {j}" for j in range(4)])
    assert texts(spark, rows) == want


def brute_templates(pages, least, share, place, beside):
    """Counts of every block over the different articles of its host, one by one."""
    hosts = {}
    for host, blocks in pages:
        hosts.setdefault(host, set()).add(tuple(blocks))
    out = set()
    for host, contents in hosts.items():
        for t in {t for c in contents for t in c}:
            at = [(c.index(t), len(c) - 1 - c.index(t), (None, *c)[c.index(t)], (*c, None)[c.index(t) + 1])
                  for c in contents if t in c]
            n, kinds = len(at), [Counter(x) for x in zip(*at)]
            if n >= max(least, share * len(contents)) and max(max(k.values()) for k in kinds[:2]) >= place * n \
                    and max(map(len, kinds[2:])) >= beside * n:
                out.add((host, t))
    return out


def test_placed_templates_against_brute_force(spark):
    rng = random.Random(9)
    made = []
    for k in range(300):
        blocks = [f"t{rng.randrange(400)}" for _ in range(rng.randrange(2, 7))]
        blocks = ([f"top{int(rng.random() < .2)}"] if rng.random() < .8 else []) + blocks \
            + (["end"] if rng.random() < .7 else [])
        made.append((f"h{rng.randrange(3)}.x", blocks))
    rows = pages(spark, [(k, f"http://{h}/", "<main>" + "".join(f"<p>{t}</p>" for t in b) + "</main>")
                         for k, (h, b) in enumerate(made)])
    want = brute_templates(made, html.MIN_PLACED, html.SITE_SHARE, html.SAME_PLACE, html.OTHER_BESIDE)
    names = dict(zip(html.block_hashes(sorted({t for _, b in made for t in b})), sorted({t for _, b in made for t in b})))
    got = {(r.host, names[r.block]) for r in html.placed_templates(html.structure(rows)).collect()}
    assert got == want and want


def test_a_page_of_many_skipped_and_nested_elements():
    many = "<span class='ad'>x</span> word " * 20_000
    assert html.candidates(f"<article><p>{many}</p></article>")[0] == ["word " * 19_999 + "word"]
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    assert html.candidates(f"<article>{deep}</article>")[0] == ["text"]


def test_copies_of_a_page_keep_their_text(spark):
    plain = "<div><p>One</p><p>Two</p></div><div>Three</div>"
    wrapped = "<div id=page><div>Site</div><article><p>Four</p><div>Five</div></article></div>"
    rows = [(k, "http://a.b/", plain) for k in range(4)] + [(10 + k, "http://c.d/", wrapped) for k in range(4)]
    got = texts(spark, rows)
    assert all(got[k] == "One\nTwo\nThree" and got[10 + k] == "Four\nFive" for k in range(4))


def test_a_subtree_with_an_article_is_no_template():
    """Also if it is equal on pages that differ elsewhere."""
    blocks, around, marks, _ = html.candidates("<div><div>Box</div><div role=\"main\"><p>Text</p></div></div>")
    assert blocks == ["Text"] and around == [[]] and len(marks) == 1


@pytest.mark.parametrize("tag", ["svg", "math", "object", "canvas"])
def test_embedded_elements_without_an_end(tag):
    def blocks(page):
        return html.candidates(f"<article><p>One</p>{page}<p>Last</p></article>")[0]
    assert blocks(f"<{tag}/>") == blocks(f"<{tag} a='b'>") == ["One", "Last"]
    assert blocks(f"<{tag}><p>x</p><{tag}>y</{tag}>z</{tag}>") == ["One", "Last"]
    assert blocks(f"<{tag}/><p>Two</p><{tag}>x</{tag}>") == ["One", "Two", "Last"]
    assert blocks(f"<{tag}><p>Two</p><{tag}>x</{tag}><!-- </{tag}> -->") == ["One", "Two", "Last"]


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "just text"), (None, "http://a/", "<p>a"), (4, "http://a/", "</p></div>"),
            (5, "http://a/", "<article><p>" + "word " * 50_000 + "</article>"), (6, "http://a/", "<script>x"),
            (7, "http://a/", "<p>a</p>﻿<p title='>'>b<br>c</p><"), (7, "http://a/", "<p>second row</p>"),
            (8, "http://a/", "<div " + "x='" * 2000)]
    got = html.extract(pages(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert by[1] == by[2] == by[6] == [""] and by[3] == ["just text"] and by[None] == ["a"] and by[4] == [""]
    assert by[5] == [("word " * 50_000).strip()] and "b c" in by[7][0] + by[7][1] and "second row" in by[7]
    assert html.extract(pages(spark, [])).count() == 0


@pytest.mark.parametrize("url,want", [("https://A.b/c", "a.b"), (None, ""), ("x.y/z", "x.y"), ("http://u@h?q", "h")])
def test_host(url, want):
    assert html.host(url) == want


def test_small_table_against_its_layout(spark):
    """The table's pages have one article each: its blocks, cut out by patterns."""
    got = {r.page_id: r for r in queries.QUERIES["op4_html"](spark, SMALL).collect()}
    rows = table(spark, SMALL, "pages").collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        blocks = [" ".join(unescape(re.sub(r"<br>|</?b>", " ", b)).split())
                  for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].url == r.url
