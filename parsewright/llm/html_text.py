"""HTML extraction (operator 7): gradient-boosted trees over DOM nodes, decoded down the hierarchy.

A page is read into a tree of elements, with every run of inline content as a leaf. Each node gets features: its tag and
those of its ancestors, the words of its class, id and role attributes and its ancestors', depth, place among and number
of siblings, and densities of its subtree (text, links, tags, sentences, paragraphs) against the page. Boosted trees give
each node the log-odds that it holds main text. Decoding takes the set of nodes with the largest total that is closed
under taking parents: no node is kept below a dropped one, and none is dropped that holds a kept one's text.

The trees are fitted on pages made here, whose main text is known (``sample_pages`` of them, a documented bound): many
layouts of articles among menus, headers, footers, sidebars, notices, adverts, forms and reader comments. In half of
them neither the article's place nor what its tag or links give away has a helpful name: articles right in the body, in
sections, cells and boxes of any class.

Defined results: a null or empty page, or one without main text, gives the empty text; broken markup is read as
browsers do for unclosed paragraphs, list items, cells and stray quotes; references are decoded; white space in a block
becomes one space; ``br`` counts as white space; a very long or very deep page is read whole, in time in proportion to its
length; equal sums of a subtree decide against it; repeated rows each give a row; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, common

#: As browsers do, a tag ends at the first > outside a quoted value, and a quote opens a value only right after =.
TOKENS = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*"|'[^']*')?)*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe select".split())
INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img "
    # pictures and formulas stand in the text around them
    "noscript object svg g defs path rect circle line polygon text tspan math semantics annotation mrow mi mo mn mtext msup msub msubsup mfrac msqrt mroot mover munder").split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul body".split())
#: (elements that a new one of their kind closes, where the search for them ends)
SELF_CLOSING = ((("li",), ("ul", "ol", "menu")), (("dt", "dd"), ("dl",)), (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), (("td", "th"), ("tr", "table")), (("option",), ("select",)))
CLOSES_LIKE = {"li": 0, "dt": 1, "dd": 1, "tr": 2, "td": 3, "th": 3, "option": 4}
SCOPES = frozenset("table td th button object".split())  # within which a p before them stays open

#: Kinds of tags and of attribute words, each a feature.
TAG_KINDS = [set(k.split()) for k in (
    "article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "nav menu", "header", "footer address", "aside", "form fieldset input button label select",
    "ul ol li dl dt dd", "table tbody tr td th thead", "blockquote pre figure figcaption", "#text", "html body")]
WORD_KINDS = [set(k.split()) for k in (
    "article content contents main story entry post body text prose page copy maincontent articlebody read",
    "nav navigation navbar menu menus breadcrumb breadcrumbs toc pagination pager tabs links skip",
    "header masthead head top topbar banner logo hero branding",
    "footer foot bottom copyright legal colophon imprint",
    "sidebar side aside rail widget widgets column secondary complementary related recommended more popular trending teaser tags archive",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense dfp outbrain taboola commercial",
    "comment comments reply replies respondent disqus discussion respond feedback review reviews reader",
    "cookie cookies consent notice alert gdpr modal popup overlay dialog toast privacy message warning banner",
    "form login signup subscribe newsletter search register contact share social follow facebook twitter")]
WIDTH = 2 * len(TAG_KINDS) + 2 * len(WORD_KINDS) + 22


class Tree:
    """Nodes in page order; parallel lists."""

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.words: list[frozenset[str]] = []
        self.text: list[str] = []  # of #text leaves, clean
        self.linked: list[int] = []  # characters in links, of leaves
        self.inline: list[int] = []  # inline tags, of leaves

    def add(self, tag: str, parent: int, words: frozenset[str] = frozenset(), text: str = "", linked: int = 0, inline: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.words.append(words)
        self.text.append(text)
        self.linked.append(linked)
        self.inline.append(inline)
        return len(self.tag) - 1


@functools.lru_cache(4096)
def attribute_words(attributes: str) -> frozenset[str]:
    found = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label", "itemprop", "data-component"):
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", entities.unescape(value.strip("\"'")))
            found.update(WORD.findall(value.lower()))
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            found.add("hidden")
    if re.search(r"(?:^|\s)hidden(?:\s|$|/)", ATTRIBUTE.sub(" ", attributes)):
        found.add("hidden")
    return frozenset(found)


def parse(page: str) -> Tree:
    """The page's tree. Comments, declarations, scripts, styles and other raw elements leave nothing."""
    tree = Tree()
    stack = [tree.add("html", -1)]
    names = ["html"]
    open_ = Counter(names)
    # for each open element the place of the nearest p that a block closes, and of what each kind's search meets first
    near_p, near = [-1], [(-1,) * len(SELF_CLOSING)]
    run: list[str] = []
    linked, inline, in_link = 0, 0, 0

    def flush() -> None:
        nonlocal linked, inline
        if run:
            text = SPACE.sub(" ", "".join(run)).strip()
            if text:
                tree.add("#text", stack[-1], text=text, linked=linked, inline=inline)
            run.clear()
        linked = inline = 0

    def push(tag: str, words: frozenset[str]) -> None:
        k = len(names)
        stack.append(tree.add(tag, stack[-1], words))
        names.append(tag)
        open_[tag] += 1
        near_p.append(-1 if tag in SCOPES else k if tag == "p" else near_p[-1])
        near.append(tuple(k if tag in same or tag in limits else up for (same, limits), up in zip(SELF_CLOSING, near[-1], strict=True)))

    def close(k: int) -> None:
        flush()
        open_.subtract(names[k:])
        for x in (stack, names, near_p, near):
            del x[k:]

    at, n = 0, len(page)
    for_lower = None
    while at < n:
        m = TOKENS.search(page, at)
        if m is None:
            run.append(entities.unescape(page[at:]))  # a reference never goes on behind a tag
            linked += in_link and n - at
            break
        if m.start() > at:
            run.append(entities.unescape(page[at : m.start()]))
            linked += (m.start() - at) if in_link else 0
        at = m.end()
        if m[2] is None:
            continue
        ending, tag = m[1] == "/", m[2].lower()
        if not ending and tag in RAW and not m[3].endswith("/"):
            if for_lower is None:
                for_lower = page.lower() if page.isascii() else re.sub(r"[A-Z]+", lambda x: x[0].lower(), page)
            stop = for_lower.find(f"</{tag}", at)
            if stop < 0:
                at = n
            else:
                gt = page.find(">", stop)
                at = n if gt < 0 else gt + 1
            run.append(" ")
            continue
        if tag in RAW:
            continue
        if tag in INLINE:
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                in_link = 0 if ending else 1
            inline += not ending
            continue
        if ending:
            if open_[tag] > (tag == "html"):
                k = len(names) - 1
                while names[k] != tag:
                    k -= 1
                close(k)
            else:
                flush()  # a stray end tag still ends a block
            in_link = 0
            continue
        flush()
        if tag in ("html", "body", "head"):
            if tag == "body":
                tree.words[0] |= attribute_words(m[3])
            if tag == "head":
                pass
            continue
        if tag in CLOSES_P and near_p[-1] > 0:
            close(near_p[-1])
        kind = CLOSES_LIKE.get(tag)
        if kind is not None:
            same = SELF_CLOSING[kind][0]
            while (k := near[-1][kind]) > 0 and names[k] in same:
                close(k)
                if tag != "tr":
                    break
        if tag in VOID:
            continue
        if m[3].endswith("/") and tag not in CLOSES_P:
            continue
        push(tag, attribute_words(m[3]) if m[3] else frozenset())
    flush()
    return tree


def features(tree: Tree) -> np.ndarray:
    """A row for each node."""
    n = len(tree.tag)
    parent = tree.parent
    x = np.zeros((n, WIDTH))
    tags, words = len(TAG_KINDS), len(WORD_KINDS)
    chars, linked, nodes, blocks, sentences, paragraphs, longest, inline = (np.zeros(n) for _ in range(8))
    children, order, depth = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        p = parent[k]
        if p >= 0:
            order[k] = children[p]
            children[p] += 1
            depth[k] = depth[p] + 1
            x[k, tags : 2 * tags] = np.maximum(x[p, tags : 2 * tags], x[p, :tags])
            x[k, 2 * tags + words : 2 * tags + 2 * words] = np.maximum(x[p, 2 * tags + words : 2 * tags + 2 * words], x[p, 2 * tags : 2 * tags + words])
        tag = tree.tag[k]
        for j, kind in enumerate(TAG_KINDS):
            if tag in kind:
                x[k, j] = 1
        if tree.words[k]:
            for j, kind in enumerate(WORD_KINDS):
                x[k, 2 * tags + j] = len(kind & tree.words[k])
            x[k, -1] = "hidden" in tree.words[k]
        t = tree.text[k]
        if t:
            chars[k], linked[k], blocks[k], longest[k], inline[k] = len(t), min(tree.linked[k], len(t)), 1, len(t), tree.inline[k]
            sentences[k] = t.count(". ") + t.count("? ") + t.count("! ") + (t[-1] in ".!?")
        paragraphs[k] = tag == "p"
        nodes[k] = 1
    for k in range(n - 1, 0, -1):
        p = parent[k]
        for a in (chars, linked, nodes, blocks, sentences, paragraphs, inline):
            a[p] += a[k]
        longest[p] = max(longest[p], longest[k])
    total, up = max(chars[0], 1), np.maximum(np.array(parent), 0)
    c = np.maximum(chars, 1)
    o = 2 * tags + 2 * words
    sibling_chars = np.zeros(n)
    for k in range(1, n):
        sibling_chars[parent[k]] = max(sibling_chars[parent[k]], chars[k])
    for j, v in enumerate((
        np.log1p(chars), chars / total, linked / c, nodes / c * 100, sentences / c * 100, np.log1p(paragraphs), np.log1p(longest), chars / np.maximum(blocks, 1), depth, order, children[up], order / np.maximum(children[up], 1),
        chars / np.maximum(chars[up], 1), chars / np.maximum(sibling_chars[up], 1), linked[up] / np.maximum(chars[up], 1), np.log1p(chars[up]), inline / c * 100, np.arange(n) / n, children,
        # whether the page has elements that say they hold the article, by tag and by attribute
        np.full(n, x[:, 0].any()), np.full(n, x[:, 2 * tags].any()))):
        x[:, o + j] = v
    hidden = x[:, -1].copy()
    for k in range(1, n):
        hidden[k] = max(hidden[k], hidden[parent[k]])
    x[:, -1] = hidden
    return x


def decode(tree: Tree, margin: np.ndarray) -> list[str]:
    """Texts of the kept leaves: the parent-closed set of nodes with the largest total margin."""
    n = len(tree.tag)
    gain = margin.astype(float).copy()  # of keeping a node with the best of what is below it
    for k in range(n - 1, 0, -1):
        if gain[k] > 0:
            gain[tree.parent[k]] += gain[k]
    kept = np.zeros(n, bool)
    kept[0] = True
    out = []
    for k in range(1, n):
        kept[k] = kept[tree.parent[k]] and gain[k] > 0
        if kept[k] and tree.text[k]:
            out.append(tree.text[k])
    return out


def made_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page and the texts of its main blocks."""
    syllables = "an be con de er for ge hu in ka lo mi no or pa ra se ti un ve wa xi yo zu th ing ou ea st".split()

    def words(a: int, b: int, stop: str = "") -> str:
        text = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))
        return text.capitalize() + stop

    def prose(a: int, b: int) -> str:
        return " ".join(words(4, 16, rng.choice("...?!")) for _ in range(rng.randint(a, b)))

    def link() -> str:
        return f'<a href="/{rng.randint(0, 999)}">{words(1, 3)}</a>'

    plain = rng.random() < 0.5  # the article's place has no helpful name, nor have boxes that their tag or their links give away

    def anyhow() -> str:
        """An attribute that says nothing, or none."""
        return rng.choice(["", f' class="{words(1, 1).lower()}{rng.choice(["", "", str(rng.randint(1, 99))])}"', f' id="{rng.choice("abcdefghkqwxyz")}{rng.randint(1, 99)}"', f' class="{words(1, 2).lower()}"'])

    def box(tags: str, names: str, inner: str) -> str:
        tag, name = rng.choice(tags.split()), rng.choice(names.split())
        if plain and (tag in ("nav", "header", "footer", "aside") or (inner.count("<a ") > 1 and ". " not in inner and rng.random() < 0.5)):
            return f"<{tag}{anyhow()}>{inner}</{tag}>"
        how = rng.randint(0, 3)
        at = "" if tag not in ("div", "section", "p", "ul") and how == 0 else f' {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "", "-" + str(rng.randint(1, 99)), " box", "-wrapper"])}"'
        return f"<{tag}{at}>{inner}</{tag}>"

    def links(a: int, b: int) -> str:
        items = [link() for _ in range(rng.randint(a, b))]
        return rng.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), " ".join(items)])

    main: set[str] = set()

    def keep(text: str) -> str:
        main.add(SPACE.sub(" ", text).strip())
        return text

    def marked(text: str) -> str:
        """The text with inline markup in it, which does not change what it says."""
        kind = rng.random()
        tag = rng.choice("b i em strong span code".split())
        if kind < 0.15:
            return f"<{tag}>{text}" + rng.choice(["<br>", f"</{tag}>", ""])  # often never closed
        if kind < 0.35:
            return " ".join(f"<{tag}>{w}</{tag}>" if rng.random() < 0.15 else w for w in text.split(" "))
        if kind < 0.55:
            return " ".join(f'<a href="/{len(w)}">{w}</a>' if rng.random() < 0.12 else w for w in text.split(" "))
        if kind < 0.65:
            return " ".join(w + "<br>" * (rng.random() < 0.1) for w in text.split(" ")).replace("<br> ", "<br>")
        return text

    def block() -> str:
        kind = rng.random()
        if kind < 0.68:
            text = keep(prose(1, 6) if rng.random() < 0.7 else words(1, 14, rng.choice([".", "", "."])))
            return f"<p>{marked(text)}" + "</p>" * (rng.random() < 0.85)
        if kind < 0.76:
            return f"<h{(h := rng.randint(2, 4))}>{keep(words(1, 7))}</h{h}>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{keep(words(2, 12))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote>{marked(keep(prose(1, 3)))}</blockquote>"
        if kind < 0.92:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{keep(words(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>"
        if kind < 0.95:
            return f"<pre>{keep(words(3, 20))}</pre>"
        if kind < 0.97:
            return advert()
        return f"<div>{keep(prose(1, 4))}</div>"

    def advert() -> str:
        return box("div div aside section", "ad ads advert sponsored promo advertisement ad-slot", rng.choice([words(3, 12, "."), prose(1, 2), link(), f"<p>{prose(1, 2)}</p>"]))

    def comments() -> str:
        one = lambda: box("div li article", "comment reply comment-body", f"<p>{prose(1, 3)}</p>" if rng.random() < 0.6 else words(1, 3) + f"<p>{prose(1, 2)}</p>")
        return box("section div div", "comments comment-list discussion reader-comments responses-comments", (f"<h3>{words(1, 3)}</h3>" if rng.random() < 0.6 else "") + "".join(one() for _ in range(rng.randint(1, 5))))

    def notice() -> str:
        return box("div div aside", "cookie-notice consent notice alert gdpr-banner cookie-banner", rng.choice([prose(1, 2), f"<p>{prose(1, 2)}</p><button>{words(1, 2)}</button>"]))

    def form() -> str:
        return f'<form action="/x">{words(1, 4)} <label>{words(1, 2)}</label><input type="text"><button>{words(1, 2)}</button></form>' if rng.random() < 0.6 else box("div", "newsletter subscribe login signup search", f"<p>{words(3, 10, '.')}</p><form><input><button>{words(1, 1)}</button></form>")

    def sidebar() -> str:
        inner = "".join(rng.choice([lambda: f"<h4>{words(1, 3)}</h4>{links(2, 6)}", lambda: f"<p>{prose(1, 2)}</p>", advert, form, lambda: words(3, 9, "."), lambda: f"<ul>{''.join(f'<li>{words(2, 7)}</li>' for _ in range(3))}</ul>"])() for _ in range(rng.randint(1, 4)))
        return box("aside aside div div", "sidebar side rail widget-area related secondary", inner)

    def placed(blocks: list[str]) -> str:
        """The blocks where nothing but the text says that it is the article."""
        inner, how = "".join(blocks), rng.randint(0, 6)
        if how == 0:
            return inner  # right in the body
        if how == 1:
            return f"<div{anyhow()}>{inner}</div>"
        if how == 2:  # sections
            cut = rng.randint(1, 4)
            inner = "".join(f"<section{anyhow()}>{''.join(blocks[k : k + cut])}</section>" for k in range(0, len(blocks), cut))
            return inner if rng.random() < 0.4 else f"<div{anyhow()}>{inner}</div>"
        if how == 3:  # a table as layout
            side = f"<td{anyhow()}>{links(3, 8)}</td>" * (rng.random() < 0.7)
            return f"<table{anyhow()}><tr>{side}<td{anyhow()}>{inner}</td></tr></table>"
        if how == 4:
            for _ in range(rng.randint(2, 4)):
                inner = f"<div{anyhow()}>{inner}</div>"
            return inner
        if how == 5:  # boxes instead of paragraphs
            return f"<div{anyhow()}>" + "".join(re.sub(r"<(/?)p>", lambda m: f"<{m[1]}div>", x) if x.endswith("</p>") else f"<div{anyhow()}>{x}</div>" for x in blocks) + "</div>"
        return f"<{(tag := rng.choice(['article', 'main', 'center', 'span']))}{anyhow()}>{inner}</{tag}>"

    title = keep(words(2, 9)) if rng.random() < 0.85 else ""
    blocks = [f"<h1>{title}</h1>"] * bool(title) + [block() for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20]))]
    inner = "".join(blocks)
    wrap = rng.randint(0, 5)
    if plain:
        article = placed(blocks)
    elif wrap <= 2:
        article = f"<article>{inner}</article>"
    elif wrap == 3:
        article = box("div section main", "content article-body post entry-content story main-content text", inner)
    elif wrap == 4:
        article = f"<main>{inner}</main>"
    else:
        article = box("div", "content post article story", f"<div>{inner}</div>")
    if not plain and rng.random() < 0.3:  # furniture within the article's own box
        tail = "".join(rng.choice([advert, form, comments, lambda: box("div", "share social related tags", links(2, 4))])() for _ in range(rng.randint(1, 2)))
        article = article[: article.rindex("</")] + tail + article[article.rindex("</") :]
    before = [x for p, x in (
        (0.85, box("nav nav div ul", "nav menu navbar main-menu top-nav", links(3, 8))), (0.45, box("header header div", "header masthead top site-header", f"{words(1, 4)} {link()}" if rng.random() < 0.6 else f"<p>{words(3, 12, '.')}</p>")),
        (0.35, notice()), (0.5, advert()), (0.2, box("div ol", "breadcrumb breadcrumbs", links(2, 4))), (0.2, form()), (0.2, sidebar())) if rng.random() < p]
    after = [x for p, x in ((0.35, sidebar()), (0.4, comments()), (0.35, advert()), (0.25, form()), (0.2, notice()), (0.2, box("div section", "related more recommended", f"<h3>{words(1, 3)}</h3>{links(2, 5)}")),
        (0.9, box("footer footer footer div", "footer site-footer bottom copyright", rng.choice([f"&copy; {words(1, 3)} &middot; {prose(1, 3)}", f"<p>{prose(1, 2)}</p>", words(2, 12, "."), links(2, 6)])))) if rng.random() < p]
    rng.shuffle(before)
    if plain and rng.random() < 0.25:
        before, after = [], after[-1:]
    middle = "".join(before) + article + "".join(after)
    if rng.random() < 0.4:
        middle = f'<div class="{rng.choice(["page", "wrapper", "container", "layout", "site", "k7", "x"])}">{middle}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{middle}</body></html>", main


@functools.lru_cache(2)
def model(sample_pages: int = 900, seed: int = 5) -> boosting.Boosted:
    """Trees fitted on ``sample_pages`` made pages; a node's label is whether main text lies in it."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(sample_pages):
        page, main = made_page(rng)
        tree = parse(page)
        y = np.array([t in main if t else False for t in tree.text])
        for k in range(len(y) - 1, 0, -1):
            y[tree.parent[k]] |= y[k]
        xs.append(features(tree))
        ys.append(y)
    return boosting.fit(np.concatenate(xs), np.concatenate(ys).astype(float), trees=90, depth=5)


def extract(pages: DataFrame, trees: boosting.Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks for every row of pages (page_id, url, html)."""
    trees = trees or model()
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    table = pages.sparkSession.sparkContext.broadcast(trees)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks int"
    arrow = common.to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = table.value
        for batch in batches:
            for part in common.slices(batch):
                for k in range(0, part.num_rows, 200):
                    some = part.slice(k, 200)
                    parsed = [parse(p) for p in common.texts_of(some, "html")]
                    rows = [features(t) for t in parsed]
                    margin = trees.margins(np.concatenate(rows))
                    texts, counts, a = [], [], 0
                    for t in parsed:
                        kept = decode(t, margin[a : a + len(t.tag)])
                        a += len(t.tag)
                        texts.append("\n".join(kept))
                        counts.append(len(kept))
                    yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int32())], schema=arrow)

    return common.map_arrow(pages, run, schema)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.load(spark, sf_dir, "pages"))
