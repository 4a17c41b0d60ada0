"""HTML extraction with site style trees (operator 1).

The pages of a host are merged into one tree. A node is a path of elements; it holds how often each style (the sequence of
its children) and each content (all text below it) occurred there. Presentation importance is the entropy of the styles,
content importance that of the contents, each as a share of the most that so many pages allow; a branch's importance is
the mean of the two. What is alike on all pages of a site is of low importance, what differs from page to page is of high.

Few pages say little: the importance is drawn towards a prior, as if SHRINK more pages had shown it. The prior is 1, or 0
for elements with a role or with a word in class or id that says advert, sidebar, notice or the like. A branch goes if its
importance is below LOW; one with such a mark goes unless its importance reaches HIGH, which only branches do whose
layout and text both differ from page to page.

What HTML itself gives no text of the page (scripts, head, forms and the like), navigation, footers, asides, hidden
elements, and reader comments go by name. Inside article and main elements nothing goes for its importance. An element
that goes by name or mark stays if it holds the page's only article or most of its text.
"""

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm.common import no_null, row_slices, written

#: Branches of less importance are removed; marked ones are unless they reach HIGH; and how many pages the prior counts as.
LOW, HIGH, SHRINK = 0.2, 0.75, 2
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_SEED = (1 << 64) - 1
_SPACE = re.compile(r"\s+")
#: Elements without content, of raw text, that end an open paragraph, and that end an open element of their own kind: fixed by HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noframes xmp iframe noembed".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = frozenset("table ul ol dl select html body".split())
#: No article: by element, and by a role that says so.
_DROP = frozenset("head title script style noscript template nav footer aside form button select option input textarea iframe object embed canvas svg audio video menu dialog noframes noembed xmp".split())
_DROP_ROLES = frozenset("navigation contentinfo complementary search form dialog alertdialog menu menubar".split())
#: Reader comments, by a word of class or id (see _says).
_COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: Marks that the style tree decides about: roles, and words of class or id.
_MARK_ROLES = frozenset("banner alert toolbar".split())
_MARK_WORDS = frozenset("ad ads advert advertisement adverts adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead related recommended share sharing social popup modal overlay widget pagination pager toolbar search skip".split())
#: Parts of a class word that name a piece of layout, and those that speak of what lies elsewhere.
_LAYOUT = frozenset("area bar block body bottom box btn button buttons card cell column container content feed footer form frame group head header holder icon icons inline inner item items left link links list main outer panel placeholder region right row section slot space strip thread top unit wrap wrapper zone".split())
_ELSEWHERE = frozenset("has have hide is js no non not show toggle with without".split())
_PART = re.compile(r"[-_]+|(?<=[a-z0-9])(?=[A-Z])")
_SIZE = re.compile(r"\d+(?:x\d+)?")
_PLAIN, _MARKED, _GONE = 0, 1, 2
#: Of those, what a browser never shows as text of the page.
_NO_TEXT = frozenset("title script style noscript template button select option input textarea iframe object embed canvas svg audio video noframes noembed xmp".split())


class Node:
    """mark: whether the element is plain, marked for the style tree to decide, or goes by name. id: a hash of the path."""

    __slots__ = ("children", "id", "inside", "mark", "name", "tag")

    def __init__(self, tag: str, name: str, parent: "Node | None", mark: int):
        self.tag, self.name, self.mark, self.children = tag, name, mark, []
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.id = xxh64_intdigest(f"{mark} {name}".encode("utf-8", "replace"), parent.id & _SEED if parent else 0) - (1 << 63)


def _says(value: str, words: frozenset[str]) -> bool:
    """Whether a class or id names one of the words: as a whole, as its last part (site-footer), or as its first before layout or a size (ad-slot, commentList, ad_300x250)."""
    for token in value.split():
        if token.lower() in words:
            return True
        parts = [p for p in _PART.split(token) if p]
        if len(parts) > 1 and (low := [p.lower() for p in parts])[0] not in _ELSEWHERE:
            if low[-1] in words or low[0] in words and all(p in _LAYOUT or _SIZE.fullmatch(p) for p in low[1:]):
                return True
    return False


def _node(tag: str, attributes: str, parent: Node) -> Node:
    name, mark = tag, _GONE if tag in _DROP else _PLAIN
    if attributes and len(attributes) > 3:
        seen = set()
        for m in _ATTRIBUTE.finditer(attributes):
            kind = m[1].lower()
            if kind in seen:  # of equal names the first counts
                continue
            seen.add(kind)
            given = m[2] or m[3] or m[4] or ""
            value = given.lower()
            if kind == "class":
                name = ".".join([tag, *sorted(value.split())])
            if kind in ("class", "id"):
                if value and tag not in ("html", "body", "article", "main"):
                    mark = max(mark, _GONE if _says(given, _COMMENTS) else _MARKED if _says(given, _MARK_WORDS) else _PLAIN)
            elif kind == "role":
                mark = max(mark, _GONE if value.strip() in _DROP_ROLES else _MARKED if value.strip() in _MARK_ROLES else _PLAIN)
            elif kind == "hidden" or kind == "aria-hidden" and value.strip() == "true" or kind == "style" and _NO_DISPLAY.search(value):
                mark = _GONE
    out = Node(tag, name, parent, mark)
    if tag == "header" and not out.inside:  # a page's header goes, an article's heading stays
        out.mark = _GONE
    return out


def parse(page: str) -> Node:
    """The page as a tree: unclosed and misplaced tags are settled the way browsers do in the common cases."""
    root = Node("", "", None, _PLAIN)
    stack, opened, at, find = [root], Counter(), 0, _TOKEN.match

    def close(i: int) -> None:
        for node in stack[i:]:
            opened[node.tag] -= 1
        del stack[i:]

    while m := find(page, at):
        at = m.end()
        closing, tag, attributes, text = m.groups()
        if text is not None:
            stack[-1].children.append(text)
        elif tag is not None:
            tag = tag.lower()
            if closing:
                if opened[tag]:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == tag:
                            close(i)
                            break
                        if stack[i].tag in _SCOPE and tag not in _BLOCK:
                            break
                continue
            if tag in _BLOCK and opened["p"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in _BLOCK:
                        break
            if (ends := _ENDS.get(tag)) and any(opened[x] for x in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        close(i)
                        break
                    if stack[i].tag in _SCOPE:
                        break
            node = _node(tag, attributes, stack[-1])
            stack[-1].children.append(node)
            if tag in _RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                if tag in ("textarea", "title"):
                    node.children.append(page[at : end.start() if end else len(page)])
                at = end.end() if end else len(page)
            elif tag not in _VOID and not attributes.rstrip().endswith("/"):
                stack.append(node)
                opened[tag] += 1
    return root


class Kept:
    """Which elements of a page are kept, by the low branches of its host. None: no host is known, and marked elements go."""

    def __init__(self, root: Node, low: frozenset[int] | None):
        self.low, self.rescued = low, set()
        order, work = [], [(root, -1, False)]
        while work:  # parents first
            node, parent, gone = work.pop()
            gone = gone or self.drops(node)
            at = len(order)
            order.append((node, parent, gone))
            work += [(c, at, gone) for c in node.children if isinstance(c, Node) and c.tag not in _NO_TEXT]
        size = [sum(len(c.strip()) for c in node.children if isinstance(c, str)) for node, *_ in order]
        holds = [False] * len(order)
        for at in range(len(order) - 1, 0, -1):
            node, parent, _ = order[at]
            size[parent] += size[at]
            holds[parent] = holds[parent] or holds[at] or node.tag in ("article", "main")
        kept = any(node.tag in ("article", "main") and not gone for node, _, gone in order)
        for at, (node, _, _) in enumerate(order):
            # Beside a kept article or main, neither teasers in a sidebar nor long comments are rescued.
            if node.mark != _PLAIN and self.drops(node) and (2 * size[at] > size[0] and (node.inside or not kept) or holds[at] and not kept):
                self.rescued.add(id(node))

    def drops(self, node: Node) -> bool:
        if node.mark == _GONE:
            low = True
        elif self.low is None:
            low = node.mark == _MARKED
        else:
            low = node.id in self.low and (node.mark == _MARKED or not node.inside and node.tag not in ("article", "main"))
        return low and id(node) not in self.rescued


def _squeezed(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


def _blocks(top: Node, kept: Kept) -> list[str]:
    """The texts of the blocks below an element that are kept, in page order."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        if held:
            if text := _squeezed("".join(held)):
                out.append(text)
            held.clear()

    work: list = [(top, iter(top.children))]  # by hand, not by recursion: nesting may be deep
    while work:
        node, rest = work[-1]
        child = next(rest, None)
        if child is None:
            if node.tag in _BLOCK:
                end()
            work.pop()
        elif isinstance(child, str):
            held.append(child)
        elif child.tag == "br":
            held.append(" ")
        elif not kept.drops(child):
            if child.tag in _BLOCK:
                end()
            work.append((child, iter(child.children)))
    end()
    return out


def _articles(root: Node, kept: Kept) -> list[Node]:
    """The outermost article elements that are kept, or else main elements."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    work = [root]
    while work:
        node = work.pop()
        if node.tag in found:
            found[node.tag].append(node)
            if node.tag == "article":
                continue
        work += [c for c in reversed(node.children) if isinstance(c, Node) and not kept.drops(c)]
    return found["article"] or found["main"]


def main_text(page: str, low: frozenset[int] | None = None) -> str:
    """The blocks of the page's articles (or main elements), if these hold at least half of the text that is kept; else of the whole page."""
    root = parse(page)
    kept = Kept(root, low)
    whole = _blocks(root, kept)
    if tops := _articles(root, kept):
        parts = [text for top in tops for text in _blocks(top, kept)]
        if 2 * sum(map(len, parts)) >= sum(map(len, whole)):
            return "\n".join(parts)
    return "\n".join(whole)


def features(page: str) -> list[tuple[int, int, int, int]]:
    """What a page adds to its site's tree: (node, mark, hash of its style, hash of its content), once for each path.

    Equal names beside one another count once in a style, so that one paragraph more is no other style. Elements at one
    path are taken together: their styles as a set, their contents one after the other."""
    root = parse(page)
    style, content, marks = {}, {}, {}
    order, work = [], [root]
    while work:  # parents first
        node = work.pop()
        order.append(node)
        work += reversed([c for c in node.children if isinstance(c, Node) and c.tag not in _NO_TEXT and c.children])
    digest: dict[int, int] = {}
    for node in reversed(order):
        names, h = [], 0
        for c in node.children:
            if isinstance(c, Node):
                name, part = c.name, digest.get(id(c), 0)
            else:
                words = c.split()
                name, part = "#" if words else "", xxh64_intdigest(" ".join(words).encode("utf-8", "replace")) if words else 0
            if name and (not names or names[-1] != name):
                names.append(name)
            if part:
                h = (h * 0x9E3779B97F4A7C15 + part) & _SEED
        digest[id(node)] = h
        if names and node is not root:
            at = node.id
            marks[at] = node.mark
            style.setdefault(at, set()).add(xxh64_intdigest(" ".join(names).encode("utf-8", "replace")))
            content[at] = (content.get(at, 0) * 0x9E3779B97F4A7C15 + h) & _SEED
    return [(at, marks[at], (sum(style[at]) & _SEED) - (1 << 63), content[at] - (1 << 63)) for at in style if marks[at] != _GONE]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in row_slices(batches, "html"):
        host, rows = [], []
        for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got = features(page)
            rows += got
            host += [h] * len(got)
            if len(rows) > 1 << 18:
                yield _batch(host, rows)
                host, rows = [], []
        yield _batch(host, rows)


def _batch(host: list[str], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["host", "node", "mark", "style", "content"])


def branch_importance(pages: DataFrame) -> DataFrame:
    """(host, node, mark, pages, importance) of each branch, from pages (host, html).

    Copies of a page count once: pages are grouped by host and hash first, or one page under many urls would pass for what
    the host's pages share. Values are counted before the shuffle and then summed by node, so a hot host or path is no hot task.
    """
    pages = pages.groupBy("host", F.xxhash64("html").alias("sum")).agg(F.first("html").alias("html")).select("host", "html")
    seen = pages.mapInArrow(_features, "host string, node long, mark long, style long, content long")
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("style").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("v")
    counts = seen.select("host", "node", "mark", kinds).groupBy("host", "node", "mark", "v.kind", "v.value").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    by = counts.groupBy("host", "node", "mark", "kind").agg(total.alias("pages"), (F.log(total) - F.sum(F.col("n") * F.log("n")) / total).alias("entropy"))
    share = F.when(F.col("pages") > 1, F.greatest(F.col("entropy"), F.lit(0.0)) / F.log("pages")).otherwise(0.0)
    nodes = by.groupBy("host", "node", "mark").agg(F.max("pages").alias("pages"), F.avg(share).alias("own"))
    prior = F.when(F.col("mark") == _PLAIN, 1.0).otherwise(0.0)
    return nodes.select("host", "node", "mark", "pages", (((F.col("pages") - 1) * F.col("own") + SHRINK * prior) / (F.col("pages") - 1 + SHRINK)).alias("importance"))


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, low): the branches of low importance of each host that has any, from pages (host, html)."""
    low = F.col("importance") < F.when(F.col("mark") == _PLAIN, LOW).otherwise(HIGH)
    return branch_importance(pages).filter(low).groupBy("host").agg(F.collect_list("node").alias("low"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page: its article without what belongs to the site.

    Where article elements (or else main elements) hold half of the text that is kept or more, the text is theirs; elsewhere
    it is the whole body's, less what is dropped. Character references are decoded, white space inside a block becomes one space, blocks are joined by
    one newline. Null html is empty; the text of an empty page is empty. Null urls belong to one host. Repeated rows are
    given each; an empty table gives none; other columns are not read. Pages
    are parsed whole, however long or deep: time and memory grow with their length alone.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col), F.col(url_col), host.alias("__host"), no_null(html_col).alias("__html"))
    known = written(low_branches(rows.select(F.col("__host").alias("host"), F.col("__html").alias("html"))), "low-branches").withColumnRenamed("host", "__of")

    @F.arrow_udf("string")
    def extracted(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, known = None, frozenset()
        for pages, hosts, low in batches:
            out = []
            for p, h, x in zip(pages, hosts.to_pylist(), low, strict=True):
                if h != last:  # pages of a host stand side by side: its branches become a set once
                    last, known = h, frozenset(x.as_py() or ())
                out.append(main_text(p.as_py(), known))
            yield pa.array(out, pa.string())

    out = rows.join(known, F.col("__host") == F.col("__of"), "left")
    return out.select(id_col, url_col, extracted.asNondeterministic()("__html", "__host", "low").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
