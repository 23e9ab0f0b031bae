"""Main text of web pages by site template removal.

Element subtrees are hashed bottom-up (tag and content). Spark counts, per host, on how many different pages each
subtree stands, inside articles and outside; subtrees that recur on ``PAGES`` of them, however many pages the host has,
are the site's template and are deleted with all they hold. Pages with the same article count as one, so copies of an
article do not turn its parts into template. An article, what holds it, and its prose (paragraphs, headings, list items,
quotations) are never template.

Recurrence cannot tell an advert or a reader's comment that differs from page to page, so some elements go by what they
are: HTML's own elements and roles for navigation, forms and the like, and the class or id names in ``MARKS``, each
compared as a whole name and never against an element that holds the article, nor, without an article, against all the
text of a page. On a page with articles, the main text is that of the articles, with the headings of first rank before them if they have none.

Templates are broadcast while they are at most ``BROADCAST`` rows in all; beyond that each page is joined with those it
holds itself, frequent ones by broadcast, so a host with many costs no more a page.

Defined results: a null or empty html gives an empty text. A null url belongs to the host "". Repeated rows stay
repeated. An empty table gives no rows. Extra columns are ignored. Broken markup never fails: what cannot be parsed as
a tag is text, what is not closed ends with its parent, elements nested deeper than ``DEEPEST`` become siblings (but those
that are no main text, which hold what is in them at any depth), and after a quoted attribute value that never ends, tags end at their first ``>``. Parsing takes linear time.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from runlens.llm.common import join_counted, settle, text_blocks
from runlens.llm.url_reputation import host_of

#: Different pages of a host on which a subtree must recur, at least.
PAGES = 5
#: Rows of templates sent to every worker at most.
BROADCAST = 500_000

# Element names of HTML by what they mean for the text.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()) - {"br"}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt figcaption td th tr tbody caption".split())
CLOSES_P = BLOCKS - {"body", "head", "html", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
NEVER_TEXT = frozenset("head script style noscript template nav aside form button select textarea iframe object svg canvas audio video map dialog menu noframes xmp title".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Class and id names of what is not main text though it may differ from page to page.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising ad-box ad-banner ad-container adsbygoogle banner-ad sponsored promo promoted"
    " breadcrumb breadcrumbs comment comments comment-list commentlist comments-area comments-section disqus disqus_thread replies"
    " cookie-banner cookie-bar cookie-consent cookie-notice cookies-notice gdpr consent-banner notice site-notice alert-banner"
    " footer site-footer page-footer header site-header page-header masthead menu main-menu nav navbar navigation nav-menu"
    " sidebar side-bar left-sidebar right-sidebar widget widget-area newsletter newsletter-signup subscribe-form popup modal"
    " pagination pager related related-posts related-articles recommended share share-buttons share-bar sharing social-share social-links".split()
)
KEPT_MARKS = frozenset("header page-header".split())  # in an article this is its own title block
#: Elements nested deeper than this are taken as siblings.
DEEPEST = 256

# attributes up to the end of a tag; a quote opens a value only after an equals sign
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+>")
ENDS = re.compile(r"[^>]*+>")
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")


class Element:
    __slots__ = ("tag", "parent", "children", "out", "mark", "article", "depth", "hash")

    def __init__(self, tag: str, parent: Element | None, out: bool, mark: bool, article: bool):
        self.tag, self.parent, self.out, self.mark, self.article = tag, parent, out, mark, article
        self.children: list = []
        self.depth = parent.depth + 1 if parent else 0
        self.hash = 0


def judged(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is no main text by its name, role or state, and whether by its class or id."""
    if tag in NEVER_TEXT or tag == "footer" or tag == "header" and not in_article:
        return True, False
    if tag in ("body", "html", "article", "main") or not attributes:
        return False, False
    mark = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True, False
        if name in ("class", "id"):
            own = MARKS.intersection(value.split())
            mark = mark or bool(own - KEPT_MARKS if in_article else own)
    return False, mark


class Open:
    """The open elements: the innermost one, and per open block how many inline elements of each name are open in it."""

    def __init__(self, root: Element):
        self.now, self.blocks, self.inline = root, defaultdict(int), [defaultdict(int)]
        self.again = 0  # elements of the innermost one's name that are open in it but were not entered

    def enter(self, node: Element) -> None:
        self.now = node
        if node.tag in BLOCKS:
            self.blocks[node.tag] += 1
            self.inline.append(defaultdict(int))
        else:
            self.inline[-1][node.tag] += 1

    def leave(self) -> None:
        node, self.now, self.again = self.now, self.now.parent, 0
        if node.tag in BLOCKS:
            self.blocks[node.tag] -= 1
            self.inline.pop()
        else:
            self.inline[-1][node.tag] -= 1

    def close(self, tag: str) -> None:
        """An end tag; one of an inline element reaches no further than its block, one without a start is ignored."""
        if not (self.blocks[tag] if tag in BLOCKS else self.inline[-1][tag]):
            return
        if self.again and tag == self.now.tag:
            self.again -= 1
            return
        while self.now.tag != tag:
            self.leave()
        self.leave()

    def make_room(self, tag: str) -> None:
        """What the start of an element closes: a paragraph, or the sibling before it in the same list or table."""
        if tag in CLOSES_P and self.blocks["p"]:
            node = self.now
            while node.parent is not None and node.tag not in BLOCKS:
                node = node.parent
            if node.tag == "p":
                self.close("p")
        ends, scope = SIBLINGS.get(tag, ((), ()))
        if any(self.blocks[t] if t in BLOCKS else self.inline[-1][t] for t in ends):
            node, last = self.now, None
            while node.parent is not None and node.tag not in scope:  # at most DEEPEST
                last = node if node.tag in ends else last
                node = node.parent
            while last is not None and self.now is not last.parent:
                self.leave()


def parse(page: str) -> list[Element]:
    """The page's elements in page order, the root first; children are elements and strings."""
    root = Element("#root", None, False, False, False)
    nodes, held = [root], Open(root)
    at, end, quoted, tags_end, raw_ends = 0, len(page), True, page.rfind(">"), {}
    text: list[str] = []

    def flush() -> None:
        if text:
            held.now.children.append("".join(text))
            text.clear()

    while at < end:
        found = page.find("<", at)
        if found < 0 or found > tags_end and not page.startswith("<!--", found):
            text.append(page[at:])
            break
        if found > at:
            text.append(page[at:found])
        if page.startswith("<!--", found):
            flush()  # a reference does not go on behind a comment
            at = page.find("-->", found + 4)
            at = end if at < 0 else at + 3
            continue
        if page[found + 1 : found + 2] in ("!", "?"):
            flush()
            at = page.find(">", found) + 1
            continue
        name = NAME.match(page, found + 1)
        if name is None:
            text.append("<")
            at = found + 1
            continue
        rest = REST.match(page, name.end()) if quoted else None
        if rest is None:
            quoted = False  # some quote never ends
            rest = ENDS.match(page, name.end())
        at, tag, attributes = rest.end(), name[1].lower(), rest[0][:-1]
        flush()
        if page[found + 1] == "/":
            held.close(tag)
            continue
        held.make_room(tag)
        above = held.now
        out, mark = judged(tag, attributes, above.article)
        node = Element(tag, above, above.out or out, mark, above.article or tag in ("article", "main"))
        above.children.append(node)
        nodes.append(node)
        if tag in RAW:
            if tag not in raw_ends:
                raw_ends[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)
            close = raw_ends[tag].search(page, at)
            node.children.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not attributes.endswith("/"):
            if node.depth < DEEPEST or out and not above.out or mark and not (above.out or above.mark):
                held.enter(node)
            elif tag == above.tag and node.depth > DEEPEST:
                held.again += 1
    flush()
    return nodes


def drop_marked(nodes: list[Element]) -> None:
    """Marked elements are no main text, unless they hold an article or, on a page without one, no text would be left."""
    holders = holds_article(nodes)
    gone = set()
    for node in nodes[1:]:
        if id(node.parent) in gone or node.mark and id(node) not in holders:
            gone.add(id(node))
    if not holders and not any(c.__class__ is str and not c.isspace() for n in nodes if not n.out and id(n) not in gone for c in n.children):
        return
    for node in nodes:
        node.out = node.out or id(node) in gone


def hash_subtrees(nodes: list[Element]) -> None:
    """Elements in page order: from the back, children come before their parents."""
    for node in reversed(nodes):
        parts = [node.tag]
        for c in node.children:
            if c.__class__ is Element:
                parts.append(f"<{c.hash}>")
            elif not c.isspace():
                parts.append(" ".join(c.split()))
        node.hash = xxh64_intdigest("\x00".join(parts)) - (1 << 63) if len(parts) > 1 else 0


def removable(node: Element) -> bool:
    """May be template: a block with content that is no article, holds none and is no prose of one."""
    if not node.hash or node.tag not in BLOCKS or node.tag in ("html", "body", "head", "article", "main"):
        return False
    return not (node.article and node.tag in PROSE)


def holds_article(nodes: list[Element]) -> set[int]:
    out = set()
    for node in nodes:
        if node.tag in ("article", "main") and not node.out:
            while node is not None and id(node) not in out:
                out.add(id(node))
                node = node.parent
    return out


def headings(nodes: list[Element]) -> set[int]:
    """Headings of first rank before the first article, with what holds them."""
    out: set[int] = set()
    for node in nodes:
        if node.article and not node.out:
            break
        if node.tag == "h1" and not node.out:
            while node is not None and id(node) not in out:
                out.add(id(node))
                node = node.parent
    return out


def whole(node: Element, holders: set[int]) -> bool:
    """Part of a heading that counts as an article's."""
    while node is not None and id(node) not in holders:
        node = node.parent
    return node is not None and node.tag == "h1"


def signatures(page: str) -> tuple[int, set[int]]:
    """The hash of what the page is about (its articles, else its body), and of every subtree that may be template."""
    nodes = parse(page)
    hash_subtrees(nodes)
    holders = holds_article(nodes)
    about = sorted(n.hash for n in nodes if n.tag in ("article", "main")) or [nodes[0].hash]
    return xxh64_intdigest(repr(about)) - (1 << 63), {n.hash for n in nodes if removable(n) and id(n) not in holders}


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    """The blocks of the main text, joined by line breaks."""
    nodes = parse(page)
    if template:
        hash_subtrees(nodes)
    drop_marked(nodes)
    holders = holds_article(nodes)
    if holders and not any(n.tag == "h1" and n.article and not n.out for n in nodes):
        holders |= headings(nodes)
    blocks, words = [], []

    def close():
        line = " ".join("".join(words).split())
        words.clear()
        if line:
            blocks.append(line)

    todo: list = nodes[:1]
    while todo:
        node = todo.pop()
        if node is None:
            close()
            continue
        if node.__class__ is str:
            words.append(html.unescape(node))
            continue
        if node.out or template and node.hash in template and removable(node) and id(node) not in holders:
            if node.tag in BLOCKS:  # the text around an inline element stays one block
                close()
            continue
        if node.tag == "br":
            words.append(" ")
            continue
        inside = [c for c in node.children if not holders or node.article or whole(node, holders) or c.__class__ is Element and id(c) in holders]
        if node.tag in BLOCKS:
            close()
            todo.append(None)
        todo.extend(reversed(inside))
    close()
    return "\n".join(blocks)


def templates(pages: DataFrame, least: int = PAGES) -> DataFrame:
    """Rows (host, hash, pages): the subtrees that recur on at least ``least`` different pages of a host."""

    def run(batches):
        for block in text_blocks(batches, "html"):
            hosts, hashes, about = [], [], []
            for host, page in zip(block.column("host").to_pylist(), block.column("html").to_pylist(), strict=True):
                subject, own = signatures(page or "")
                hosts += [host] * len(own)
                hashes += own
                about += [subject] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(about, pa.int64())], names=["host", "hash", "about"])

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, hash long, about long")
    return rows.distinct().groupBy("host", "hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)


def extract(pages: DataFrame, least: int = PAGES, broadcast: int = BROADCAST) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    known = settle(templates(pages, least), "templates")
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = f"page_id {kinds['page_id']}, url string, text string, n_chars long"

    def texts(block, own):
        made = [main_text(page or "", own(k)) for k, page in enumerate(block.column("html").to_pylist())]
        return pa.RecordBatch.from_arrays([block.column("page_id"), block.column("url"), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if known.count() <= broadcast:
        by_host = defaultdict(set)
        for r in known.collect():  # at most ``broadcast`` rows
            by_host[r.host].add(r.hash)
        sent = pages.sparkSession.sparkContext.broadcast({h: frozenset(v) for h, v in by_host.items()})

        def with_broadcast(batches):
            for block in text_blocks(batches, "html"):
                hosts = block.column("host").to_pylist()
                yield texts(block, lambda k: sent.value.get(hosts[k], frozenset()))

        return rows.mapInArrow(with_broadcast, out)
    numbered = settle(rows.withColumn("row", F.monotonically_increasing_id()), "pages")

    def held(batches):
        for block in text_blocks(batches, "html"):
            own = [list(signatures(page or "")[1]) for page in block.column("html").to_pylist()]
            at = pa.array([k for k, s in enumerate(own) for _ in s], pa.int64())
            yield pa.RecordBatch.from_arrays([block.column("row").take(at), block.column("host").take(at), pa.array([h for s in own for h in s], pa.int64())], names=["row", "host", "hash"])

    held_rows = settle(numbered.select("row", "host", "html").mapInArrow(held, "row long, host string, hash long").select("row", F.xxhash64("host", "hash").alias("key"), "hash"), "subtrees")
    keyed = known.select(F.xxhash64("host", "hash").alias("key"), "pages").distinct()
    hits = join_counted(held_rows, keyed, "key", "pages", known.agg(F.sum("pages")).first()[0])
    joined = numbered.join(hits.groupBy("row").agg(F.collect_list("hash").alias("template")), "row", "left").select("page_id", "url", "html", "template")

    def with_join(batches):
        for block in text_blocks(batches, "html"):
            own = block.column("template").to_pylist()
            yield texts(block, lambda k: frozenset(own[k] or ()))

    return joined.mapInArrow(with_join, out)
