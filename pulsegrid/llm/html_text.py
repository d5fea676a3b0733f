"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.llm.common import prepare, text_slices

# Element kinds of HTML and the words that mark page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q ruby rb rp rt s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
FURNITURE = set(
    "head script style noscript template nav footer aside button select input textarea iframe object embed svg canvas audio video "
    "dialog menu title xmp noembed noframes".split()
)
FURNITURE_WORDS = set(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer masthead menu modal nav navbar navigation newsletter notice popup promo promoted sidebar sponsor sponsored".split()
)
NO_FURNITURE_WORDS = set("has layout no with without".split())  # "has-sidebar" names a wrapper, not a sidebar
FURNITURE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
CLOSED_BY = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
P_ENDS = set(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
SCOPE = set("article body div section table td th ul ol dl main aside nav header footer form blockquote".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>"
    r"|<[!?/][^>]*>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
REMARKS = re.compile(r"comment|disqus|respond|reply", re.IGNORECASE)
WORD_BREAK = re.compile(r"[^A-Za-z0-9]+")


CERTAIN, LIKELY = 2, 1
MOST = 0.9  # share of a page's running text that no menu, notice or form holds


def furniture(tag: str, rest: str, inside_article: bool) -> int:
    """How sure an element is a menu, header, footer, sidebar, notice, advert, form, script or comment area.

    ``CERTAIN`` by its tag or because it is hidden; ``LIKELY`` by role, class, id or as a form, which wrappers of whole
    pages may be as well.
    """
    if tag in FURNITURE or (tag == "header" and not inside_article):
        return CERTAIN
    likely = LIKELY if tag == "form" else 0
    if not rest or tag in ("html", "body"):
        return likely
    for name, *values in ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values).lower()
        if tag in ("article", "main"):
            continue
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return CERTAIN
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return CERTAIN
        if name == "role" and value in FURNITURE_ROLES:
            likely = LIKELY
        if name in ("class", "id"):
            names = (set(WORD_BREAK.split(v)) for v in value.split())
            if any(not FURNITURE_WORDS.isdisjoint(n) and NO_FURNITURE_WORDS.isdisjoint(n) for n in names):
                likely = LIKELY
    return likely


class OpenElements:
    """The stack of open elements, with the places of each tag, so that no lookup walks the stack."""

    def __init__(self):
        self.nodes, self.tags, self.at, self.solid = [0], ["#root"], {"#root": [0]}, [0]

    def push(self, node: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.nodes))
        if tag not in INLINE:
            self.solid.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a tag; 0, the root's, if there is none."""
        places = self.at.get(tag)
        return places[-1] if places else 0

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.nodes) > place:
            self.nodes.pop()
            tag = self.tags.pop()
            self.at[tag].pop()
            if tag not in INLINE:
                self.solid.pop()


class Page:
    """Nodes of one page in page order: parent, tag, characters, tags, link characters, link tags; and its texts."""

    def __init__(self, source: str):
        self.parent, self.tag, self.kind = [-1], ["#root"], [0]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.remarks = [False]  # areas of reader comments, whose single comments may be marked up as articles
        self.texts: list[tuple[int, int, str]] = []  # node, block, text
        self.block = 0
        self._read(source)

    def _open(self, stack: OpenElements, tag: str, rest: str) -> None:
        closes = CLOSED_BY.get(tag, set()) | ({"p"} if tag in P_ENDS else set())
        if closes:
            bars = SCOPE if tag in ("li", "tr") else SCOPE | {"li", "tr"}
            place = max(map(stack.last, closes))
            if place > max(map(stack.last, bars - closes)):
                stack.cut(place)
        above = stack.nodes[-1]
        if tag == "br":
            self.texts.append((above, self.block, " "))
        elif tag not in INLINE:
            self.block += 1
        node = len(self.parent)
        self.parent.append(above)
        self.tag.append(tag)
        self.kind.append(furniture(tag, rest, bool(stack.last("article") or stack.last("main"))))
        self.remarks.append(bool(self.kind[node]) and bool(REMARKS.search(rest)))
        for counts in (self.chars, self.tags, self.link_chars, self.link_tags):
            counts.append(0)
        if tag not in VOID:
            stack.push(node, tag)

    def _close(self, stack: OpenElements, tag: str) -> None:
        if tag in ("html", "body"):
            return
        place = stack.last(tag)
        if place > (stack.solid[-1] if tag in INLINE else max(stack.last("body"), stack.last("html"))):
            stack.cut(place)
        if tag not in INLINE:
            self.block += 1

    def _read(self, source: str) -> None:
        stack, at, last = OpenElements(), 0, source.rfind(">")
        while at < len(source):
            start = source.find("<", at)
            if start < 0 or start > last:
                start = len(source)
            token = TOKEN.match(source, start) if start < len(source) else None
            stop = start if token or start == len(source) else start + 1
            if stop > at:
                self.texts.append((stack.nodes[-1], self.block, source[at:stop]))
            at = max(stop, start)
            if not token:
                continue
            at = token.end()
            tag = token["tag"]
            if not tag:
                continue
            tag = tag.lower()
            if token["close"]:
                self._close(stack, tag)
                continue
            self._open(stack, tag, token["rest"])
            if tag in RAW:
                end = re.compile(f"</{tag}", re.IGNORECASE).search(source, at)
                stop = end.start() if end else len(source)
                self.texts.append((len(self.parent) - 1, self.block, source[at:stop]))
                at = stop

    def _drop(self) -> list[bool]:
        """Which nodes lie in furniture. What is only likely stays if it holds an article or most of the page's running text."""
        count = len(self.parent)
        certain, linked = [False] * count, [False] * count
        for node in range(1, count):
            above = self.parent[node]
            certain[node] = certain[above] or self.kind[node] == CERTAIN
            linked[node] = linked[above] or self.tag[node] == "a"
        running, holds = [0] * count, [False] * count
        for node, _, text in self.texts:
            if not (certain[node] or linked[node]):
                running[node] += len(text) - text.count(" ") - text.count("\n")
        for node in range(count - 1, 0, -1):
            above = self.parent[node]
            running[above] += running[node]
            holds[above] |= holds[node] or (self.tag[node] in ("article", "main") and not certain[node])
        dropped = [False] * count
        for node in range(1, count):
            keeps = not self.remarks[node] and (holds[node] or running[node] >= MOST * running[0] > 0)
            dropped[node] = dropped[self.parent[node]] or self.kind[node] == CERTAIN or (self.kind[node] == LIKELY and not keeps)
        return dropped

    def main_text(self) -> str:
        self.dropped = self._drop()
        texts = [(node, block, html.unescape(t)) for node, block, t in self.texts if not self.dropped[node]]
        linked = [False] * len(self.parent)
        for node in range(1, len(self.parent)):
            linked[node] = self.tag[node] == "a" or linked[self.parent[node]]
        for node, _, text in texts:
            size = len(text) - text.count(" ") - text.count("\n")
            self.chars[node] += size
            if linked[node]:
                self.link_chars[node] += size
        for node in range(len(self.parent) - 1, 0, -1):
            above = self.parent[node]
            self.chars[above] += self.chars[node]
            self.link_chars[above] += self.link_chars[node]
            if not self.dropped[node]:
                self.tags[above] += self.tags[node] + 1
                self.link_tags[above] += self.link_tags[node] + (self.tag[node] == "a")
        chosen = self._choose()
        inside = [False] * len(self.parent)
        for node in range(len(self.parent)):
            inside[node] = not self.dropped[node] and (node in chosen or (node > 0 and inside[self.parent[node]]))
        blocks: list[list[str]] = []
        current = -1
        for node, block, text in texts:
            if inside[node]:
                if block != current:
                    blocks.append([])
                    current = block
                blocks[-1].append(text)
        lines = (" ".join("".join(parts).split()) for parts in blocks)
        return "\n".join(line for line in lines if line)

    def _choose(self) -> set[int]:
        """Content roots: subtrees of the largest density sum under nodes as dense as the thinnest on the body path."""
        body = next((n for n, t in enumerate(self.tag) if t == "body"), 0)
        whole_links = self.link_chars[body] / max(1, self.chars[body])
        density = [0.0] * len(self.parent)
        for node in range(len(self.parent)):
            c = self.chars[node]
            if c:
                t, lc, lt = max(1, self.tags[node]), max(1, self.link_chars[node]), max(1, self.link_tags[node])
                free = max(1, c - self.link_chars[node])
                base = math.log(c / free * lc + whole_links * c + math.e)
                density[node] = c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(base) if base > 1.0 else 0.0
        total = [0.0] * len(self.parent)
        best = list(range(len(self.parent)))  # in each subtree, the node of the largest sum
        for node in range(1, len(self.parent)):
            total[self.parent[node]] += density[node]
        for node in range(len(self.parent) - 1, 0, -1):
            above = self.parent[node]
            if total[best[node]] > total[best[above]]:
                best[above] = best[node]
        top = best[body]
        threshold, node = density[top], top
        while node not in (body, 0):
            threshold = min(threshold, density[node])
            node = self.parent[node]
        roots: set[int] = set()
        covered = [False] * len(self.parent)
        for node in range(body, len(self.parent)):
            above = self.parent[node]
            covered[node] = node in roots or (above >= 0 and covered[above])
            if not covered[node] and not self.dropped[node] and self.chars[node] and density[node] >= threshold and node != body:
                roots.add(best[node] if total[best[node]] else node)
                covered[node] = node in roots
        return {self._article(n) for n in roots or {top}}

    def _article(self, node: int) -> int:
        """The outermost article around a node, else the node: an article is taken whole."""
        found = node
        while node > 0:
            if self.tag[node] in ("article", "main"):
                found = node
            node = self.parent[node]
        return found


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars``, from the whole ``html``.

    Every node's density is its link-adjusted characters per tag; the subtree whose children's densities sum highest is
    the content, together with others at least as dense as the thinnest node between it and the body. An article is
    taken whole. Null and empty pages and pages without text give an empty text. Rows are kept one for one; other
    columns are ignored.
    """

    prepare(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sources in text_slices(batch, "html"):
                texts = [Page(s).main_text() if s else "" for s in sources.to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {"page_id": rows.column(0), "url": rows.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
                )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
