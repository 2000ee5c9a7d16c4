"""HTML extraction with union-free wrappers.

Pages of one host are turned into nested streams of block tags and texts. Streams are aligned one after another: equal
tags meet, a text that differs becomes a slot, a run that repeats becomes a repeated group, and what only one side has
becomes optional. The result is a regular expression without unions, the wrapper of the host, with counts of the text
that its places hold. The wrapper decides which element of the host's pages holds the article; pages are then read
along it.

Partial wrappers are inferred where pages lie, equal ones are merged before the shuffle, and partial wrappers of one
host meet in salted groups first, so a host with a third of all pages sends few rows.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Generator, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .registry import query, table

#: Elements whose text is never part of an article.
APART = frozenset("""nav footer aside form script style noscript template button select option textarea iframe svg object
canvas head title menu dialog""".split())
#: Words in a class, id or role that mark the same.
APART_WORDS = frozenset("""ad ads advert advertisement advertising sponsor sponsored promo promoted banner cookie cookies
consent gdpr notice alert popup modal sidebar side menu nav navbar navigation breadcrumb breadcrumbs comment comments
disqus reply replies share sharing social related recommended newsletter subscribe signup login search footer header
masthead toolbar widget widgets pagination pager skip""".split())
#: Of these, words of reader comments and lists of other articles: they hold article elements that are not the article.
FOREIGN_WORDS = frozenset("comment comments disqus reply replies related recommended newsletter ad ads advert".split())
#: A name that begins or ends so tells how a box is laid out, not what it is: "no-sidebar", "page-header" inside an article.
LAYOUT_WORDS = frozenset("has no with without is".split())
HEAD_WORDS = frozenset("header masthead".split())
ENTRY_WORDS = frozenset("post entry article story content".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
#: Elements without an end tag, elements that do not break a line, and starts that end an open element of the same kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp
small span strike strong sub sup time tt u var""".split())
#: Single blocks of a text; an article is what holds them.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption ul ol dl figure table tbody tr td th".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
IMPLIED_END = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
               "th": {"td", "th"}, "option": {"option"}}
#: A start tag of these ends an open paragraph.
ENDS_PARAGRAPH = frozenset("""address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main
nav ol p pre section table ul""".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*+\"(?=[\s/>]|\Z)|'[^']*+'(?=[\s/>]|\Z)|[\"'])*+)(>|\Z)", re.S)
NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Longest run of different elements that is looked for as a repeated group, and groups that partial wrappers of a host meet in.
PERIOD, SALTS = 3, 32
#: Texts from this length on are kept in a wrapper as their beginning and a digest of the whole.
SHOWN = 80


class Node:
    """An element or a text (``sig`` "#") of a page or a wrapper."""

    __slots__ = ("sig", "kids", "text", "optional", "repeated", "chars", "links", "pages", "inside", "holds")

    def __init__(self, sig: str, text: str | None = None):
        self.sig, self.text, self.kids = sig, text, []
        self.optional = self.repeated = False
        self.chars = self.links = self.inside = 0
        self.pages, self.holds = 1, False


def signature(tag: str, attributes: str) -> str:
    """Tag and the sorted words of its class, id and role; names that only tell the layout are one word each ("no_sidebar")."""
    words: set[str] = set()
    for found in NAME.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").lower().split():
            parts = [w for w in re.split(r"[^a-z]+", name) if w]
            words.update(["_".join(parts)] if parts and parts[0] in LAYOUT_WORDS else parts)
    words = sorted(words)
    return f"{tag}.{'.'.join(words)}" if words and tag not in ARTICLE | {"body", "html"} else tag


def parse(page: str | None) -> Node:
    """Nested block elements of a page; inline tags vanish, their text joins the block."""
    root = Node("")
    stack, at, page = [root], 0, page or ""
    in_link = 0

    def add(text: str, link: bool) -> None:
        kids = stack[-1].kids
        if kids and kids[-1].sig == "#":
            kids[-1].text += text
        elif text:
            kids.append(Node("#", text))
        else:
            return
        if link:
            kids[-1].links += len(text.strip())

    def close(names: set[str], within: frozenset[str] | set[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = stack[depth].sig.split(".")[0]
            if tag in names:
                del stack[depth:]
                return
            if tag in within:
                return

    size = len(page)
    while at < size:
        found = TOKEN.search(page, at)
        if not found:
            add(page[at:], in_link > 0)
            break
        if found.start() > at:
            add(page[at: found.start()], in_link > 0)
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        ended = found[4] == ">"
        if found[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag not in INLINE and tag not in VOID and ended:
                close({tag}, {"table"} if tag in IMPLIED_END else set())
            continue
        if not ended:  # the page stops inside a tag
            break
        if tag in VOID:
            add(" ", False) if tag != "wbr" else None
            if tag == "hr":
                close({"p"}, ARTICLE)
            continue
        if tag in INLINE:
            in_link += tag == "a"
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>|\Z", re.I).search(page, at)
            node = Node(signature(tag, found[3]))
            stack[-1].kids.append(node)
            at = end.end()
            continue
        if tag in ENDS_PARAGRAPH:
            close({"p"}, ENDS_PARAGRAPH - {"p"})
        if tag in IMPLIED_END:
            close(IMPLIED_END[tag], {"ul", "ol", "dl", "table"})
        node = Node(signature(tag, found[3]))
        stack[-1].kids.append(node)
        if not found[3].rstrip().endswith("/"):
            stack.append(node)
    return root


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def run(steps: Generator):
    """The result of steps that yield the steps whose result they wait for: trees of any depth, without deep calls."""
    stack, value = [steps], None
    while stack:
        try:
            inner = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(inner)
            value = None
    return value


def shown(text: str) -> str:
    """A text as a wrapper keeps it: whole, or its beginning and a digest, so different long texts stay different."""
    return text if len(text) < SHOWN else f"{text[:SHOWN // 2]}… {hashlib.sha1(text.encode('utf-8', 'replace')).hexdigest()}"


def learn(node: Node) -> Node:
    """The wrapper of one page: texts cleaned and counted, runs folded."""
    return run(_learn(node))


def _learn(node: Node) -> Generator:
    kids = []
    for kid in node.kids:
        if kid.sig == "#":
            text = clean(kid.text)
            if text:
                kid.text, kid.chars = shown(text), len(text)
                kids.append(kid)
        else:
            kids.append((yield _learn(kid)))
    node.kids = yield _fold(kids)
    return node


def _fold(kids: list[Node]) -> Generator:
    """Runs of equal neighbours become repeated nodes, runs of up to ``PERIOD`` different ones repeated groups."""
    out, i = [], 0
    while i < len(kids):
        for period in range(1, PERIOD + 1):
            sigs = [k.sig for k in kids[i: i + period]]
            end = i + period
            while len(sigs) == period and [k.sig for k in kids[end: end + period]] == sigs:
                end += period
            if end > i + period and (period == 1 or len(set(sigs)) > 1):
                if period == 1:
                    node = kids[i]
                    for other in kids[i + 1: end]:
                        node = yield _merge(node, other, True)
                else:
                    node = Node(f"({'+'.join(sigs)})")
                    node.kids = kids[i: i + period]
                    for j in range(i + period, end, period):
                        for place in range(period):
                            node.kids[place] = yield _merge(node.kids[place], kids[j + place], True)
                node.repeated = True
                out.append(node)
                i = end
                break
        else:
            out.append(kids[i])
            i += 1
    return out


def merge(a: Node, b: Node, same_page: bool = False) -> Node:
    """Two nodes of one signature as one; ``same_page``: they repeat in a page."""
    return run(_merge(a, b, same_page))


def _merge(a: Node, b: Node, same_page: bool) -> Generator:
    out = Node(a.sig, a.text if a.text == b.text else None)
    out.optional, out.repeated = a.optional or b.optional, a.repeated or b.repeated
    out.chars, out.links = a.chars + b.chars, a.links + b.links
    out.pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    out.kids = yield _align(a.kids, b.kids, same_page)
    return out


def common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. Equal ends are set aside; a row of lengths is one whole number of bits."""
    head, end, stop = 0, min(len(x), len(y)), 0
    while head < end and x[head] == y[head]:
        head += 1
    while stop < end - head and x[-1 - stop] == y[-1 - stop]:
        stop += 1
    a, b = x[head: len(x) - stop], y[head: len(y) - stop]
    places: dict[str, int] = {}
    for j, sig in enumerate(b):
        places[sig] = places.get(sig, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, row = [], full
    for sig in a:
        met = row & places.get(sig, 0)
        row = ((row + met) | (row - met)) & full
        rows.append(row)
    i, j, middle = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                middle.append((head + i, head + j))
    pairs = [(k, k) for k in range(head)] + middle[::-1]
    return pairs + [(len(x) - k, len(y) - k) for k in range(stop, 0, -1)]


def _align(x: list[Node], y: list[Node], same_page: bool) -> Generator:
    """Longest common stream; what only one side has is optional. Neighbours of one signature that this brings together
    become one repeated node."""
    out: list[Node] = []
    i = j = 0
    pairs = common([k.sig for k in x], [k.sig for k in y])
    matched = len(pairs) == len(x) == len(y)
    for p, q in [*pairs, (len(x), len(y))]:
        for alone in [*x[i:p], *y[j:q]]:
            alone.optional = True
            if out and out[-1].sig == alone.sig:
                out[-1] = yield _merge(out[-1], alone, True)
                out[-1].repeated = True
            else:
                out.append(alone)
        i, j = p + 1, q + 1
        if p < len(x):
            node = yield _merge(x[p], y[q], same_page)
            if not matched and out and out[-1].sig == node.sig:
                node = yield _merge(out[-1], node, True)
                node.repeated = True
                out[-1] = node
            else:
                out.append(node)
    return out


def pack(node: Node) -> list:
    """A wrapper as rows from the root on, each followed by its kids."""
    rows, stack = [], [node]
    while stack:
        node = stack.pop()
        rows.append([node.sig, node.text, int(node.optional), int(node.repeated), node.chars, node.links, node.pages, len(node.kids)])
        stack.extend(reversed(node.kids))
    return rows


def unpack(rows: list) -> Node:
    nodes: list[Node] = []
    for sig, text, optional, repeated, chars, links, pages, kids in reversed(rows):
        node = Node(sig, text)
        node.optional, node.repeated, node.chars, node.links, node.pages = bool(optional), bool(repeated), chars, links, pages
        node.kids = [nodes.pop() for _ in range(kids)]
        nodes.append(node)
    return nodes.pop()


def expression(node: Node) -> str:
    """The wrapper as a regular expression over tags; ``#`` is a text slot."""
    words: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            words.append(part)
            continue
        marks = "+" * part.repeated + "?" * part.optional
        if marks:
            words.append("(")
            stack.append(f"){marks}")
        if part.sig == "#":
            words.append("#" if part.text is None else json.dumps(part.text, ensure_ascii=False))
        elif part.sig and not part.sig.startswith("("):
            words.append(f"<{part.sig}>")
            stack.append("</>")
        stack.extend(reversed(part.kids))
    return " ".join(words)


def apart(sig: str, in_article: bool) -> bool:
    """Whether an element's text is not part of an article.

    Headings are never told apart by a name; boxes named header belong to an article that they stand in.
    """
    tag, *words = sig.split(".")
    if tag in APART or (tag == "header" and not in_article):
        return True
    marks = APART_WORDS.intersection(words)
    if in_article or not HEAD_WORDS.isdisjoint(marks) and not ENTRY_WORDS.isdisjoint(words):
        marks -= HEAD_WORDS
    return bool(marks) and not (tag in HEADINGS and marks <= HEAD_WORDS)


def spared(node: Node, whole: int, most: float = 0.8) -> bool:
    """Whether an element that a name sets apart is the page's own frame: it holds an article or main element, or nearly
    all text. Comments and lists of other articles are not, whatever they hold."""
    tag, *words = node.sig.split(".")
    if tag in APART or tag == "header" or not FOREIGN_WORDS.isdisjoint(words):
        return False
    return node.holds or node.inside >= most * whole > 0


def measure(root: Node) -> None:
    """Characters inside each element, and whether it holds an article or main element."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node.kids)
    for node in reversed(order):
        tag = node.sig.split(".")[0]
        node.inside = 0 if tag in APART else node.chars + sum(k.inside for k in node.kids)
        node.holds = any(k.holds or k.sig in ARTICLE for k in node.kids)


def article_path(wrapper: Node, share: float = 0.6) -> tuple[str, ...]:
    """Signatures from the root to the element that holds the host's articles.

    An article or main element with text, the one with most; else the deepest element that holds ``share`` of the text
    outside menus and the like and outside links.
    """
    measure(wrapper)
    # places: parent, signature, depth, weight; the root is place 0
    places: list[list] = [[-1, "", 0, 0]]
    known: dict[tuple[int, str], int] = {}
    marked: list[tuple[int, int]] = []

    def weight(node: Node, place: int, in_article: bool) -> Generator:
        if node.sig == "#":
            # a text that many pages share is part of the template
            constant = node.text is not None and node.pages >= 5
            return 0 if constant and not in_article else max(0, node.chars - 2 * node.links)
        if apart(node.sig, in_article) and not spared(node, wrapper.inside):
            return 0
        here, total = in_article or node.sig in ARTICLE, 0
        for kid in node.kids:
            at = place
            if kid.sig != "#":
                at = known.setdefault((place, kid.sig), len(places))
                if at == len(places):
                    places.append([place, kid.sig, places[place][2] + 1, 0])
            total += yield weight(kid, at, here)
        if node.sig in ARTICLE and not in_article:
            marked.append((total, place))
        places[place][3] += total
        return total

    def path(place: int) -> tuple[str, ...]:
        out = []
        while place > 0:
            out.append(places[place][1])
            place = places[place][0]
        return tuple(reversed(out))

    everything = run(weight(wrapper, 0, False))
    if marked and max(marked)[0] > 0:
        return path(max(marked, key=lambda x: (x[0], -places[x[1]][2], -x[1]))[1])
    fitting = [i for i, (_, sig, _, w) in enumerate(places) if everything and w >= share * everything and sig.split(".")[0] not in BLOCKS]
    return path(max(fitting, key=lambda i: (places[i][2], places[i][3], -i), default=0))


def constants(wrapper: Node, path: tuple[str, ...]) -> set[tuple[str, str]]:
    """Texts of the template inside the chosen element with their places (signatures from that element on), where no article
    tag tells them apart. The same text at another place is not meant."""
    found: set[tuple[str, str]] = set()
    if ARTICLE.intersection(path):
        return found
    tops = [wrapper]
    for step in path:
        tops = [k for node in tops for k in node.kids if k.sig == step]
    stack = [(node, "") for node in tops]
    while stack:
        node, place = stack.pop()
        for kid in node.kids:
            if kid.sig == "#":
                if kid.text is not None and kid.pages >= 5 and len(kid.text) < SHOWN:
                    found.add((place, kid.text))
            else:
                stack.append((kid, place if kid.sig.startswith("(") else step_down(place, kid.sig)))
    return found


def step_down(place: str, sig: str) -> str:
    """A place one element further down; deep places are digests, so they stay short."""
    further = f"{place}>{sig}"
    return further if len(further) < 400 else hashlib.sha1(further.encode("utf-8", "replace")).hexdigest()


def article_text(page: Node, path: tuple[str, ...], drop: set[tuple[str, str]]) -> str:
    """Texts of the chosen element in page order, blocks joined by one space."""
    blocks: list[str] = []
    steps = tuple(s for s in path if not s.startswith("("))
    # node, steps of the path done, in an article, place below the chosen element; the next in page order is on top
    stack: list[tuple[Node, int, bool, str]] = [(page, 0, False, "")]
    while stack:
        node, done, inside, place = stack.pop()
        if node.sig == "#":
            text = clean(node.text)
            if text and (not drop or (place, text) not in drop):
                blocks.append(text)
            continue
        below = []
        for kid in node.kids:
            here = inside or kid.sig in ARTICLE
            if done < len(steps):
                if kid.sig == steps[done]:
                    below.append((kid, done + 1, here, ""))
            elif kid.sig == "#":
                below.append((kid, done, inside, place))
            elif not apart(kid.sig, inside):
                below.append((kid, done, here, step_down(place, kid.sig) if drop else ""))
        stack.extend(reversed(below))
    return " ".join(blocks)


def host_of(url: pd.Series) -> pd.Series:
    return url.fillna("").str.extract(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", expand=False).fillna("").str.lower()


def _infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One partial wrapper for each host and batch."""
    for pdf in batches:
        found: dict[str, Node] = {}
        for host, page in zip(host_of(pdf["url"]), pdf["html"], strict=True):
            if not page:
                continue
            own = learn(parse(page))
            found[host] = merge(found[host], own) if host in found else own
        yield pd.DataFrame({"host": list(found), "wrapper": [json.dumps(pack(w)) for w in found.values()]}, dtype=object)


def _merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
    out = None
    for row in sorted(pdf["wrapper"]):
        node = unpack(json.loads(row))
        out = node if out is None else merge(out, node)
    return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrapper": [json.dumps(pack(out))]}, dtype=object)


def _decide(pdf: pd.DataFrame) -> pd.DataFrame:
    merged = unpack(json.loads(_merge_group(pdf)["wrapper"].iloc[0]))
    path = article_path(merged)
    return pd.DataFrame({"host": pdf["host"].iloc[:1], "path": [json.dumps(path)], "drop": [json.dumps(sorted(constants(merged, path)))],
                         "wrapper": [expression(merged)]}, dtype=object)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    read: dict[str, tuple] = {}
    for pdf in batches:
        texts = []
        for page, path, drop in zip(pdf["html"], pdf["path"], pdf["drop"], strict=True):
            if not page:
                texts.append("")
                continue
            key = path + drop
            if key not in read:
                read[key] = (tuple(json.loads(path)), {tuple(d) for d in json.loads(drop)})
            way, template = read[key]
            text = article_text(parse(page), way, template)
            if not text:  # a page that leaves the wrapper of its host is read by its own
                text = article_text(parse(page), article_path(learn(parse(page))), template)
            texts.append(text)
        yield pdf.drop(columns=["html", "path", "drop"]).assign(text=texts, n_chars=[len(t) for t in texts])


def infer_wrappers(pages: DataFrame, url_column: str = "url", html_column: str = "html", salts: int = SALTS) -> DataFrame:
    """One row for each host: ``host``, ``wrapper`` (the expression), ``path`` of the article element, ``drop`` (template
    texts inside it, with their places)."""
    partial = pages.select(F.col(url_column).alias("url"), F.col(html_column).alias("html")).mapInPandas(
        _infer, "host string, wrapper string")
    partial = cut_lineage(partial, "partial-wrappers")
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    once = salted.groupBy("host", "salt").applyInPandas(_merge_group, "host string, wrapper string")
    return once.groupBy("host").applyInPandas(_decide, "host string, path string, drop string, wrapper string")


def extract_articles(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per row of ``pages`` the id, the url, the article's ``text`` and ``n_chars`` (code points).

    Character references are decoded; white space inside a block becomes one space; blocks stand in page order, joined
    by one space. A null or empty page has the empty text; a null or odd url is a host of its own kind (""). Repeated
    rows each get their text; a page cut short is read as far as it goes; elements may be nested to any depth; a quote that
    nothing closes is part of its tag; an empty table gives no rows; other columns, whatever their names, stay aside.
    """
    kind = dict(pages.dtypes)
    wrappers = cut_lineage(infer_wrappers(pages, url_column, html_column), "wrappers").select("host", "path", "drop")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_column), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"),
                        host.alias("host")).join(wrappers, "host", "left").drop("host")
    return rows.mapInPandas(_extract, f"id {kind[id_column]}, url {kind[url_column]}, text string, n_chars long").withColumnsRenamed(
        {"id": id_column, "url": url_column})


@query("op7_wrapper_extraction")
def op7_wrapper_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_articles(table(spark, folder, "pages"))
