"""The style tree against a tree of its own: html.parser, paths as tuples, entropies by hand."""

import math
import random
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pyarrow.parquet as pq

from tessera.llm.queries import op1_site_style
from tessera.llm.site_style import HIGH, LOW, SHRINK, extract_text, main_text

WORDS = {"ad", "sidebar", "notice", "banner", "promo", "widget"}


class Tree(HTMLParser):
    def __init__(self, page):
        super().__init__()
        self.stack, self.styles, self.texts, self.marks = [()], defaultdict(list), defaultdict(list), {}
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        words = sorted((dict(attrs).get("class") or "").split())
        name = ".".join([tag, *words])
        self.styles[self.stack[-1]].append(name)
        self.stack.append((*self.stack[-1], name))
        self.marks[self.stack[-1]] = bool(WORDS & set(words))

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.strip():
            self.styles[self.stack[-1]].append("#")
            for i in range(len(self.stack[-1]) + 1):
                self.texts[self.stack[-1][:i]].append(data)


def brute_texts(pages):
    """Texts of a site's pages, where no path occurs twice on a page but for paragraphs."""
    trees = [Tree(p) for p in pages]
    seen = defaultdict(lambda: (Counter(), Counter()))
    for t in map(Tree, dict.fromkeys(pages)):
        for path in {x[:i] for x in t.texts for i in range(1, len(x) + 1)}:
            style = [x for i, x in enumerate(t.styles[path]) if not i or x != t.styles[path][i - 1]]
            seen[path][0][tuple(style)] += 1
            seen[path][1][tuple(t.texts[path])] += 1
    low = set()
    for path, both in seen.items():
        n = sum(both[0].values())
        share = sum(-sum(k / n * math.log(k / n) for k in c.values()) / math.log(n) if n > 1 else 0 for c in both) / 2
        marked = next(t.marks[path] for t in trees if path in t.marks)
        if ((n - 1) * share + SHRINK * (not marked)) / (n - 1 + SHRINK) < (HIGH if marked else LOW):
            low.add(path)
    out = []
    for page in pages:
        t, blocks = Tree(page), []
        size = {path: sum(map(len, texts)) for path, texts in t.texts.items()}
        kept = {path for path in size if t.marks.get(path) and 2 * size[path] > size[()]}  # marked, but most of the page

        class Reader(Tree):
            def handle_data(self, data):
                at = self.stack[-1]
                if data.strip() and not any(at[:i] in low - kept for i in range(1, len(at) + 1)):
                    blocks.append(data.strip())

        Reader(page)
        out.append("\n".join(blocks))
        assert t.stack == [()]
    return out


def site(rng, n):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    say = lambda k: " ".join(word() for _ in range(k))
    top, old, partly = say(5), say(6), [say(4) for _ in range(3)]
    pages = []
    for _ in range(n):
        body = "".join(rng.choice([f"<p>{say(40)}</p>", f"<h2>{say(9)}</h2><p>{say(30)}</p>"]) for _ in range(rng.randrange(1, 6)))
        pages.append(f'<html><body><div class="top">{top}</div><div class="ad">{say(7)}</div><div class="story widget">{body}</div><div class="old"><h3>{old}</h3><h4>{rng.choice(partly)}</h4></div><div class="date">{say(2)}</div><div class="sidebar"><ul>{say(3)}</ul></div></body></html>')
    return pages


def test_tree_against_brute_force(spark):
    rng = random.Random(3)
    sites = {"one": site(rng, 1), "four": site(rng, 4), "forty": site(rng, 40), "copies": (p := site(rng, 12)) + [p[0]] * 60}
    rows = [(f"http://{h}.example/{i}", p) for h, pages in sites.items() for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "url string, html string").withColumnRenamed("url", "page_id").selectExpr("page_id", "page_id url", "html").repartition(5)
    got = {r["url"]: r["text"] for r in extract_text(df).collect()}
    want = {f"http://{h}.example/{i}": t for h, pages in sites.items() for i, t in enumerate(brute_texts(pages))}
    assert got == want
    assert "<ul>" not in "".join(got.values()) and all(got[f"http://forty.example/{i}"] != main_text(p) for i, p in enumerate(sites["forty"]))


class Article(HTMLParser):
    """The blocks of a page's article by html.parser's events alone: a block begins and ends with any block element, a br is a space."""

    BLOCKS, SKIP = set("article blockquote div figure figcaption h1 h2 h3 h4 li ol p pre section table td th tr ul header".split()), set("aside footer form nav script style".split())

    def __init__(self, page):
        super().__init__()
        self.blocks, self.held, self.depth, self.skipped = [], [], 0, []
        self.feed(page)
        self.close()

    def end(self):
        if text := " ".join("".join(self.held).split()):
            self.blocks.append(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        words = (dict(attrs).get("class") or "").split()
        if self.skipped or tag in self.SKIP or {"comments", "ad", "sidebar"} & set(words):
            self.skipped += [tag] if tag != "br" else []
        elif tag == "article":
            self.depth += 1
        elif tag == "br":
            self.held.append(" ")
        if tag in self.BLOCKS and self.depth and not self.skipped:
            self.end()

    def handle_endtag(self, tag):
        if self.skipped:
            if self.skipped[-1] == tag:
                self.skipped.pop()
        elif tag in self.BLOCKS and self.depth:
            self.end()
            self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth and not self.skipped:
            self.held.append(data)


def test_query_against_html_parser(spark):
    """Each given page's text is its article's, as read by another parser, which knows nothing of the tree or of marks beyond those of these pages."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    got = {r["page_id"]: r["text"] for r in op1_site_style(spark, "/root/testdata/sf0.01").collect()}
    odd = [p["page_id"] for p in pages if got[p["page_id"]] != "\n".join(Article(p["html"] or "").blocks)]
    assert len(got) == len(pages) and not odd


def test_query_and_what_the_tree_does(spark):
    """On the given pages all adverts go by the tree, and each text is the article's."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    got = {r["page_id"]: r for r in op1_site_style(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for p in pages:
        html = p["html"] or ""
        inner = html[html.index("<article>") : html.index("</article>") + 10] if "<article>" in html else html
        assert got[p["page_id"]]["text"] == main_text(inner) and got[p["page_id"]]["n_chars"] == len(main_text(inner))
        without = html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert main_text(without, frozenset()) != main_text(without, None)  # the advert is a branch that the tree decides about


def test_hot_words_inside_an_article_lose_no_text(spark):
    page = "<div class='search-results'><p>Body text</p></div>"
    assert main_text(page) == "Body text" and main_text("<p class='notice-of-appeal'>x y</p>") == "x y" and main_text("<div id='social-history'>z</div>") == "z"
    assert main_text("<body><p>long text of the page, told at length</p><section><article>teaser</article></section></body>") == "long text of the page, told at length\nteaser"
