"""HTML extraction by site template removal.

A page is read by a tolerant tokeniser into a tree (void elements, implied ends
of paragraphs, list items and cells; raw text of scripts and styles is skipped).
Every block element's subtree is hashed: tag, class, text and children. Spark
counts on how many pages of its host each subtree occurs; pages of equal main-text
candidates count once, so that copies of a page do not make templates of its text.

* A subtree outside articles that recurs on ``MIN_PAGES`` pages is a template. One
  that holds an article (or main) element is none.
* A text block (paragraph, heading, list item and the like) of an article may recur
  without being one: the same sentence may be written twice, and near copies of an
  article share most of theirs. It is a template if it recurs on ``MIN_PLACED`` pages
  and ``SITE_SHARE`` of the host's, has the same place in nearly all of them
  (``SAME_PLACE``, counted from the article's begin or from its end), and other blocks
  beside it in most (``OTHER_BESIDE``).

Templates are deleted from the pages that hold them.

What a page does not repeat elsewhere is still no main text if its element says
so (navigation, footer, aside, form, script ...) or is called so (class, id or
role holding words such as sidebar, cookie, comments, advert). If the page has an
article (or main) element, only its content counts. Character references are
decoded, white space inside a block becomes one space, empty blocks go, blocks
are joined in page order by line feeds.

Cases: null and empty html give an empty text; a null or odd url is a host of
its own text; text before any tag is a block; unclosed or stray tags are
tolerated, what is open at the end is closed; an embedded element (svg, object and
the like) that is self-closed or never closed is empty; rows of equal page_id are
pages of their own; an empty table gives an empty result; other columns are
neither read nor returned.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daycast.llm.common import arrow_map, bitmap, cut, hash64, signed

MIN_PAGES = 3
MIN_PLACED = 8
SITE_SHARE, SAME_PLACE, OTHER_BESIDE = 0.5, 0.9, 0.8

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe svg math object canvas "
                "noframes noembed xmp title".split())
# Of these, those that are empty if self-closed or never closed.
EMBEDDED = frozenset("svg math object canvas template noscript iframe noframes noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark "
                   "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img "
                   "input".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption "
                        "address summary".split())
ASIDE = frozenset("nav footer aside form menu dialog button select option head header datalist "
                  "fieldset audio video map".split())
# An element that begins ends an open one of these, up to the given bound.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
        "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
        "option": ("option", "select datalist")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
# Words in a class, id or role that name what is not main text.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion "
    "banner sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header "
    "masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login search share sharing social related recommended "
    "recommendations comment comments respond replies disqus discussion widget complementary "
    "contentinfo dialog form skip disclaimer copyright legal privacy announcement trending popular "
    "promoted sidenav subnav submenu rail".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_EMBEDDED_TAGS = {t: re.compile(
    rf"<!--.*?(?:-->|\Z)|<script(?=[\s/>]).*?</script\s*>"
    rf"|<(/?){t}(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I) for t in EMBEDDED}
_INLINE_TAGS = {t: re.compile(rf"<(/?){t}\b[^>]*>", re.I) for t in INLINE}
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


class _Element:
    __slots__ = ("tag", "parts", "aside", "article", "mark", "holds")

    def __init__(self, tag: str, parts: list, aside: bool, article: bool, mark: int):
        self.tag, self.parts, self.aside, self.article = tag, parts, aside, article
        self.mark = mark             # place in the page's list of subtrees, -1 if none
        self.holds = False           # an article begins in it


def named_aside(attributes: str, article: bool = False) -> bool:
    """A class, id or role names what is no main text (an article may have a header)."""
    for groups in _NAMED.findall(attributes):
        named = "".join(groups)
        words = {w.lower() for w in _WORDS.findall(named)} | set(re.findall("[a-z]+", named.lower()))
        if words & NAMES - ({"header", "masthead"} if article else set()):
            return True
    return False


def parse(html: str) -> tuple[list[tuple[str, bool, list[int]]], list[int]]:
    """(blocks, subtrees) of a page.

    A block is (text, inside an article, places of the subtrees around it) and is
    not named as aside; a subtree is a hash, 0 for one that is no template.
    """
    blocks: list[tuple[str, bool, list[int]]] = []
    subtrees: list[int] = []
    root = _Element("", [], False, False, -1)
    stack = [root]
    text: list[str] = []
    ends: dict[str, dict[int, int]] = {}        # per tag, where embedded elements end

    def flush() -> None:
        if not text:
            return
        got = _SPACE.sub(" ", unescape("".join(text))).strip()
        text.clear()
        if got:
            top = stack[-1]
            top.parts.append(got)
            if not top.aside:
                blocks.append((got, top.article, [e.mark for e in stack if e.mark >= 0]))

    def close() -> None:
        flush()
        e = stack.pop()
        if e.mark >= 0:
            subtrees[e.mark] = hash64("\x1f".join([e.tag, *e.parts]).encode("utf-8", "replace")) | 1 \
                if e.parts and not e.holds else 0
        stack[-1].parts.append(f"\x1e{subtrees[e.mark]}" if e.mark >= 0 and e.parts
                               else "\x1f".join(e.parts))

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                text.append(piece)
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in INLINE:
                continue
            if tag == "p" and all(e.tag != "p" for e in stack):
                flush()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        close()
                    break
            else:
                flush()
            continue
        if tag in EMBEDDED:
            if tag not in ends:
                ends[tag] = _embedded_ends(html, tag)
            at = ends[tag].get(at, at)
            continue
        if tag in RAW:
            done = _RAW_END[tag].search(html, at)
            at = done.end() if done else end
            continue
        if tag in INLINE:
            if tag == "br" or tag == "img":
                text.append(" ")
            elif named_aside(m.group(3), stack[-1].article) and not m.group(3).rstrip().endswith("/"):
                at = _skip(html, at, tag)
            continue
        flush()
        if tag in VOID:
            continue
        if tag in ENDS:
            same, bound = ENDS[tag]
            k = len(stack) - 1
            while k > 0 and stack[k].tag not in bound:
                if stack[k].tag in same:
                    while len(stack) > k:
                        close()
                    break
                k -= 1
        elif any(e.tag == "p" for e in stack):                  # a block ends an open paragraph
            k = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p")
            while len(stack) > k:
                close()
        up = stack[-1]
        main = tag in ("article", "main") or 'role="main"' in m.group(3)
        if main:
            for e in stack:
                e.holds = True
        article = up.article or main
        aside = up.aside or named_aside(m.group(3), up.article) or (
            tag in ASIDE and not (tag == "header" and up.article))
        if tag in ("article", "main", "body", "html"):
            aside = up.aside
        whole = main or tag in ("html", "body") or (tag in TEXT_BLOCKS and article)
        mark = -1
        if not whole:
            mark = len(subtrees)
            subtrees.append(0)
        stack.append(_Element(tag, [], aside, article, mark))
    while len(stack) > 1:
        close()
    flush()
    return blocks, subtrees


def _embedded_ends(html: str, tag: str) -> dict[int, int]:
    """Place after its end tag by place after the begin tag, of every closed element ``tag``."""
    begun, ends = [], {}
    for m in _EMBEDDED_TAGS[tag].finditer(html):
        if m.group(1):
            if begun:
                ends[begun.pop()] = m.end()
        elif m.group(1) is not None and not m.group(2).rstrip().endswith("/"):
            begun.append(m.end())
    return ends


def _skip(html: str, at: int, tag: str) -> int:
    """Place after the element ``tag`` that begins before ``at`` (nested ones counted)."""
    depth = 1
    for m in _INLINE_TAGS[tag].finditer(html, at):
        depth += -1 if m.group(1) else 1
        if not depth:
            return m.end()
    return at


def host(url: str | None) -> str:
    """Lower-cased host of a url, the url itself if it has none."""
    url = url or ""
    rest = url.split("://", 1)[-1] if "://" in url else url
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rsplit("@", 1)[-1].lower() or url


def candidates(html: str | None) -> tuple[list[str], list[list[int]], list[int], bool]:
    """(texts, subtrees around each, all subtrees, from an article) of a page's main-text
    candidates."""
    blocks, subtrees = parse(html or "")
    article = any(b[1] for b in blocks)
    if article:
        blocks = [b for b in blocks if b[1]]
    marks = signed(np.array(subtrees, np.uint64)).tolist()
    return [b[0] for b in blocks], [[marks[k] for k in b[2] if marks[k]] for b in blocks], \
        sorted({m for m in marks if m}), article


def block_hashes(texts: list[str]) -> list[int]:
    return signed(np.array([hash64(t.encode("utf-8", "replace"), 1) for t in texts], np.uint64)).tolist()


def placed(texts: list[str]) -> tuple[list[int], ...]:
    """(hash, place from the begin, from the end, hash before, hash after) of the different
    blocks of an article, each where it occurs first; 0 beside an end."""
    h = block_hashes(texts)
    first: dict[int, int] = {}
    for k, x in enumerate(h):
        first.setdefault(x, k)
    at = list(first.values())
    around = [0, *h, 0]
    return ([h[k] for k in at], at, [len(h) - 1 - k for k in at], [around[k] for k in at], [around[k + 2] for k in at])


def _keyed(pages: DataFrame) -> DataFrame:
    """Rows named by a hash of all they hold: equal pages share a name and a fate."""
    return (pages.select(F.col("page_id").cast("long").alias("page_id"),
                         F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
            .withColumn("key", F.xxhash64("page_id", "url", "html")))


_PLACED = ("block", "begin", "end", "before", "after")


def structure(pages: DataFrame) -> DataFrame:
    """(key, host, content, subtrees, around, block...) of every page: a hash of its
    main-text candidates, its subtrees, those of them that hold a candidate, and the
    text blocks of its article with their places; no texts."""
    def rows(batch: pa.RecordBatch) -> dict:
        got = [candidates(h) for h in batch.column("html").to_pylist()]
        places = [placed(g[0]) if g[3] else ([],) * 5 for g in got]
        return {"key": batch.column("key"), "host": [host(u) for u in batch.column("url").to_pylist()],
                "content": signed(np.array([hash64("\x1f".join(g[0]).encode("utf-8", "replace"))
                                            for g in got], np.uint64)),
                "subtrees": [g[2] for g in got],
                "around": [sorted({m for ms in g[1] for m in ms}) for g in got]} | {
                    c: [p[k] for p in places] for k, c in enumerate(_PLACED)}
    return arrow_map(_keyed(pages), rows, "key long, host string, content long, subtrees array<long>, "
                     "around array<long>, " + ", ".join(f"{c} array<long>" for c in _PLACED))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree) recurring on pages of its host, pages of equal content counted
    once; from ``structure`` rows."""
    return (pages.select("host", "content", F.explode("subtrees").alias("subtree")).distinct()
            .groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
            .select("host", "subtree"))


def placed_templates(pages: DataFrame, min_pages: int = MIN_PLACED) -> DataFrame:
    """(host, block): text blocks of articles that recur in one place among others."""
    articles = pages.where(F.size("block") > 0).select("host", "content", *_PLACED).dropDuplicates(["host", "content"])
    seen = articles.select("host", F.explode(F.arrays_zip(*_PLACED)).alias("b")).select("host", "b.*")
    size = articles.groupBy("host").agg(F.count("*").alias("articles"))
    often = (seen.groupBy("host", "block").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
             .join(size, "host").where(F.col("n") >= SITE_SHARE * F.col("articles")).drop("articles"))
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in _PLACED[1:]])
    # a count per value first, so that no row holds the values of a block
    values = (seen.join(often, ["host", "block"]).select("host", "block", "n", F.inline(kinds))
              .groupBy("host", "block", "n", "kind", "value").agg(F.count("*").alias("times")))

    def of(what, *kinds):
        return F.greatest(*[what(F.when(F.col("kind") == k, F.col("times"))) for k in kinds])
    return (values.groupBy("host", "block", "n").agg(of(F.max, "begin", "end").alias("placed"),
                                                     of(F.count, "before", "after").alias("beside"))
            .where((F.col("placed") >= SAME_PLACE * F.col("n")) & (F.col("beside") >= OTHER_BESIDE * F.col("n")))
            .select("host", "block"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    Pages are read twice: for the counts, and for the texts. Only pages that hold a
    template around a candidate (found by a bitmap of bounded size) are joined with
    the templates to delete.
    """
    rows = cut(structure(pages))
    around = rows.select("key", "host", F.explode("around").alias("subtree")).distinct()
    blocks = rows.select("key", "host", F.explode("block").alias("block")).distinct()
    gone = cut(around.join(templates(rows), ["host", "subtree"]).select("key", F.col("subtree").alias("gone"))
               .unionByName(blocks.join(placed_templates(rows), ["host", "block"])
                            .select("key", F.col("block").alias("gone")))
               .groupBy("key").agg(F.collect_list("gone").alias("gone")))
    held, test = bitmap(gone, F.col("key"))
    sent = pages.sparkSession.sparkContext.broadcast(held)
    schema = "page_id long, url string, text string, n_chars long"

    def out(batch: pa.RecordBatch, texts: list[str]) -> dict:
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts,
                "n_chars": [len(t) for t in texts]}

    def untouched(batch: pa.RecordBatch) -> dict | None:
        hit = test(sent.value, batch.column("key").to_numpy().view(np.uint64))
        batch = batch.filter(pa.array(~hit))
        return out(batch, ["\n".join(candidates(h)[0]) for h in batch.column("html").to_pylist()])

    def marked(batches):
        for b in batches:
            yield b.filter(pa.array(test(sent.value, b.column("key").to_numpy().view(np.uint64))))

    def pruned(batch: pa.RecordBatch) -> dict:
        texts = []
        for h, bad in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist()):
            blocks, around, _, article = candidates(h)
            bad = set(bad or ())
            own = block_hashes(blocks) if article else [0] * len(blocks)
            texts.append("\n".join(t for t, ms, b in zip(blocks, around, own)
                                   if bad.isdisjoint(ms) and b not in bad))
        return out(batch, texts)

    keyed = _keyed(pages)
    some = keyed.mapInArrow(marked, keyed.schema).join(gone, "key", "left")
    return arrow_map(keyed, untouched, schema).unionByName(arrow_map(some, pruned, schema))
