"""Main-text extraction by minimum cut.

A page is read into blocks: runs of text between block-level tags.  A linear classifier over a block's
ancestors, class names, length, links and punctuation gives it a cost for either label, which becomes
the capacity to one of two terminals.  Blocks that follow one another, and blocks near in the DOM, are
joined by smoothness edges.  The maximum flow separates content from boilerplate: what stays reachable
from the content terminal in the residual graph is the article.

Only what is never shown (scripts, styles, templates) or is part of a form is dropped by its element; all
other text is a block's, and the cut decides.

Defined results: null or empty html gives the empty text; a page that breaks off, leaves tags open or
nests them wrongly is read as far as it goes; a very long page is read whole, in one pass that grows with
its length; a block whose cost is the same either way is boilerplate; every row, repeated ones too, gives
one row; an empty table gives none; other columns pass unread, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, read_table

# Names of elements and words in class, id and role.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol option p plaintext pre section select summary table tbody tfoot thead title tr ul xmp".split())
SPACED = frozenset("br td th img input label wbr".split()) - {"wbr"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never shown, or belongs to a form.
DROPPED = frozenset("script style template textarea iframe noembed noframes annotation annotation-xml".split())
#: Their content is shown as it stands.
VERBATIM = frozenset("xmp plaintext".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Captions, cells and terms: short, and content where they aren't linked.
DATA = frozenset("figcaption caption td th dt dd li".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
OUTSIDE = frozenset("nav footer aside form button select option menu dialog head title legend fieldset".split())
INSIDE = frozenset("article main".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice alert popup modal overlay"
    " sidebar side rail widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer foot footnote-nav copyright legal disclaimer"
    " comment comments commentlist disqus reply replies respond discussion share sharing social follow related recommended recommendations more-stories trending popular newsletter"
    " subscribe subscription signup login signin search searchbox form skip hidden complementary contentinfo search-form tags tagcloud cta".split()
)
#: What else a compound name may say of a page's parts.  A bad word beside any other word is about something else: follow-up, share-price.
PART_WORDS = frozenset(
    "site page main post article entry blog story content body global primary secondary inner outer wrap wrapper container holder box block slot unit zone area region section group set module component panel card pane"
    " bar col column row grid list links link item items button buttons btn icon icons tools tool actions action label text title head header heading footer top bottom left right center middle fixed sticky mobile desktop"
    " small large posts articles stories news count feed thread form field fields input message info us me on by more responsive google display native video image wide skyscraper leaderboard rectangle".split()
)
GOOD_WORDS = frozenset("article content post entry story main body text body-text article-body entry-content post-content story-body maincontent".split())

# A quote counts only behind an equals sign; one that is never closed doesn't count, so the tag ends at the next >.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
#: Tags behind one that doesn't end: quotes no longer hide a >, so that no stretch of a broken page is read often.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>")
CUT_OFF = re.compile(r"<[a-zA-Z/][^<>]*+\Z")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in DROPPED | VERBATIM}
NOTICE = re.compile(r"©|\b(?:enable|activate|requires)\s+(?:java\s?script|cookies)", re.I)

# Weights of the classifier; positive speaks for content.
WEIGHT = {"bias": -0.6, "inside": 4.0, "outside": -8.0, "header": -5.0, "bad": -9.0, "good": 1.5, "links": -4.0, "length": 2.0, "sentence": 0.8, "prose": 0.9, "data": 0.9, "notice": -1.5}
#: Smoothness between neighbours; more if they have one parent, and between the children of one parent.
NEXT_TO, SIBLINGS, SAME_PARENT = 0.3, 0.5, 0.3


def names_boilerplate(value: str) -> bool:
    """Whether a class, id or role names a part beside the article: by a whole name, or by a compound of which nothing speaks against it.

    A first part of up to three letters is a name space (wp-footer); other words than those of page parts make
    the name one of content (legal-analysis).
    """
    for name in value.split():
        if name.lower() in BAD_WORDS:
            return True
        parts = WORDS.findall(CAMEL.sub("-", name).lower())
        known = [p in BAD_WORDS or p in PART_WORDS or len(p) == 1 for p in parts]
        if any(p in BAD_WORDS for p in parts) and all(known[1:]) and (known[0] or len(parts[0]) <= 3):
            return True
    return False


class Node:
    __slots__ = ("tag", "parent", "outside", "bad", "good", "inside", "header")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent = tag, parent
        up = parent
        self.outside = tag in OUTSIDE or (up is not None and up.outside)
        self.inside = tag in INSIDE or (up is not None and up.inside)
        self.header = (tag == "header" and not self.inside) or (up is not None and up.header)
        bad = good = False
        if attributes:
            for name, value in ATTRIBUTE.findall(attributes):
                name, plain = name.lower(), value.strip("\"'")
                value = plain.lower()
                if name in ("class", "id", "role"):
                    bad = bad or not (tag in INSIDE or tag == "body") and names_boilerplate(plain)
                    good = good or not GOOD_WORDS.isdisjoint([*value.split(), *WORDS.findall(value)])
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    bad = True
        self.bad = bad or (up is not None and up.bad)
        self.good = good or (up is not None and up.good)


class Block:
    __slots__ = ("node", "text", "linked", "prose", "data")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked
        self.prose, self.data = node.tag in PROSE, node.tag in DATA and not linked


class Reader:
    """Reads a page into blocks, in one pass."""

    def __init__(self):
        root = Node("#", None)
        self.stack, self.found, self.parts = [root], [], []
        self.open: Counter[str] = Counter()
        self.linked, self.link = 0, 0  # characters in links, and the depth at which the open link began

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.found.append(Block(self.stack[-1], text, self.linked))
            self.parts.clear()
        self.linked = 0

    def text(self, own: str) -> None:
        self.parts.append(own)
        if self.link:
            self.linked += len(own.strip())

    def pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1
        if len(self.stack) < self.link:
            self.link = 0

    def close(self, tag: str) -> None:
        self.flush()
        if self.open[tag]:
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()

    def start(self, tag: str, attributes: str) -> None:
        self.flush()
        if tag in VOID:
            return
        ends = CLOSES.get(tag, {"p"} if tag != "option" else set()) | {"p"}
        while len(self.stack) > 1 and self.stack[-1].tag in ends:
            self.pop()
        if self.stack[-1].tag in ("title", "option"):
            self.pop()
        self.stack.append(Node(tag, self.stack[-1], attributes))
        self.open[tag] += 1

    def tag(self, tag: str, closing: bool, attributes: str) -> None:
        if tag == "a":
            self.link = 0 if closing else len(self.stack)
        elif tag not in BLOCK:
            if tag in SPACED:
                self.parts.append(" ")
        elif closing:
            self.close(tag)
        else:
            self.start(tag, attributes)

    def read(self, page: str) -> list[Block]:
        at, end, pattern = 0, len(page), TAG
        while at < end:
            begin = page.find("<", at)
            if begin < 0:
                begin = end
            if begin > at:
                self.text(page[at:begin])
            at = begin
            if at == end:
                break
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                at = end if stop < 0 else stop + 3
                continue
            m = pattern.match(page, at)
            if m is None and pattern is TAG and page[at + 1 : at + 3].lstrip("/")[:1].isalpha():
                pattern = PLAIN_TAG
                m = pattern.match(page, at)
            if m is None:
                if page.startswith(("<!", "<?", "</"), at):
                    stop = page.find(">", at)
                    at = end if stop < 0 else stop + 1
                elif CUT_OFF.match(page, at):
                    at = end
                else:
                    self.text("<")
                    at += 1
                continue
            at, tag, closing = m.end(), m[2].lower(), bool(m[1])
            if tag in DROPPED or tag in VERBATIM:
                if tag in VERBATIM:
                    self.tag(tag, closing, m[3])
                else:
                    self.parts.append(" ")
                if closing or m[3].endswith("/"):
                    continue
                stop = CLOSING[tag].search(page, at)
                stop = stop.start() if stop else end
                if tag in VERBATIM:
                    self.text(page[at:stop].replace("&", "&amp;"))
                at = stop
                continue
            self.tag(tag, closing, m[3])
        self.flush()
        return self.found


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, without those that hold only white space."""
    return Reader().read(page)


def score(b: Block) -> float:
    """The classifier: above 0 for content."""
    n, w = b.node, WEIGHT
    z = w["bias"] + w["length"] * min(len(b.text) / 120, 1.0) + w["links"] * min(b.linked / max(len(b.text), 1), 1.0)
    z += w["inside"] * n.inside + w["outside"] * n.outside + w["header"] * n.header + w["bad"] * n.bad + w["good"] * n.good + w["prose"] * b.prose + w["data"] * b.data
    z += w["sentence"] * (b.text[-1] in ".!?…:;\"”»)") + w["notice"] * bool(NOTICE.search(b.text[:80]))
    return z


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours, and between a block and the last one under the same parent."""
    out: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        own = id(b.node.parent)
        if i:
            out.append((i - 1, i, SIBLINGS if blocks[i - 1].node.parent is b.node.parent else NEXT_TO))
        if own in last and last[own] < i - 1:
            out.append((last[own], i, SAME_PARENT))
        last[own] = i
    return out


def content_side(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Dinic's maximum flow; True for the nodes on the content terminal's side of the least cut."""
    n = len(scores)
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []
    source, sink = n, n + 1

    def join(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(forth)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, z in enumerate(scores):
        if z > 0:
            join(source, i, z, 0.0)
        elif z < 0:
            join(i, sink, -z, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:  # depth-first walks along rising levels, without recursion
            if a == sink:
                flow = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= least)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(graph[a]):
                e = graph[a][at[a]]
                if room[e] > least and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                at[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                at[a] += 1


def extract(page: str | None) -> str:
    """The main text of a page: its content blocks joined by newlines."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    scores = [score(b) for b in blocks]
    if min(scores) > 0:
        return "\n".join(b.text for b in blocks)
    return "\n".join(b.text for b, keep in zip(blocks, content_side(scores, edges_of(blocks))) if keep)


def extract_table(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_table(read_table(spark, sf_dir, "pages"))
