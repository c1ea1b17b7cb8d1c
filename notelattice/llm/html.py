"""Main-text extraction by tag-path ratios.

A page is cut into text nodes, each with its root-to-leaf tag path (tag names, with what class and id words say of them).
Paths are the nodes of a trie. For each path the lengths, punctuation marks and link texts of its nodes are summed:
    text ratio = characters / nodes, punctuation ratio = punctuation marks / nodes.
Both are smoothed along the tree (a path takes a share of what its parent path's whole subtree has), fused by a geometric
mean, damped by the share of link text, and weighted by what the tags say. Nothing is left of paths through menus, footers,
forms, scripts, adverts or comments: elements of such a kind, or with a class or id all of whose words say so ("comments",
"share-buttons", "ad-slot-2"). A name that has such a word among others ("share-price") is only a doubt: in an article it
halves the score of a container, whose path must then pass the threshold by itself, and does nothing to a paragraph;
outside of articles it still excludes containers. Readers' contributions are known by their form as well: elements side by
side with an author or a date in each are a thread, whatever it is called, unless the page is little else. Paths above a threshold (a share of the page's length-weighted mean) are
content. The smallest container that holds nearly all content paths then lends its short blocks (headings, one-line
paragraphs), so that nothing inside the article is dropped for being short. A block whose own text is kept is kept with
all that stands in it inline, link text too; outside a marked article, a block of nothing but links is not content. If most
of the content stands in an article's own element (article, main), nothing outside of such elements is content.

Parsing keeps the places of open elements by tag, and scoring passes over the trie once up and once down, so both take
time in proportion to the page, however deep or unclosed its tags are.

Blocks are what block-level tags separate; character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by a line feed.

Defined cases: null or empty html gives an empty text; markup without any tag is one block; unclosed and misnested tags
are closed by the block that follows; pages of any size are read whole; repeated rows give equal texts, ties in scores are
decided alike; an empty table gives an empty result. Columns named text or n_chars are replaced, all others pass through.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import release

# What HTML says of its tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes object canvas audio video".split())
DROPPED = frozenset("nav footer aside form button select option fieldset menu dialog input head search annotation annotation-xml".split()) | RAW
CONTENT = frozenset("article main".split())
CLOSED_BY_BLOCK = frozenset("p b i u em strong a span font small big s strike tt code".split())
SAME_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
LIMITS = frozenset("ul ol dl table select".split())
# Class and id words that mark what is not the article, words of layout that say nothing beside them, and words of the article.
AWAY = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer foot cookie cookies consent notice notices popup modal overlay newsletter subscribe signup login share sharing social comment comments disqus respond reply replies related recommended widget toolbar pagination pager masthead topbar skip hidden".split())
STRUCTURE = frozenset("area articles bar block bottom box button buttons card cards column container content desktop div entry entries fixed form global group head header heading holder icon icons inline inner item items label left line link links list main media mobile module news outer page pane panel post posts right row section site slot small space story strip tab tabs text thread title tools top unit user users view wrap wrapper zone".split())
NEAR = frozenset("article content post entry story main body text".split())
# Class and id words that name who wrote a contribution or when.
SIGNS = frozenset("author avatar byline commenter date dated handle member posted poster profile published said says timestamp username user when".split())
ITEMS = frozenset("div section li article blockquote dd tr".split())
CONTAINER = frozenset("div section ul ol dl table tbody tr td article main center details figure summary".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?", re.S)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")
_SPACE = re.compile(r"\s+")


def _marks(attributes: str) -> tuple[int, bool, bool]:
    """Do the attributes say that the element is not content (2: yes, 1: in doubt), or that it is, and do they name an author or a date?"""
    away, near, sign = 0, False, False
    for m in _NAMED.finditer(attributes):
        name, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            away = 2
        elif name == "role":
            away = 2 if value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog") else away
            near |= value.lower() in ("main", "article")
        elif name in ("class", "id"):
            for label in value.split():
                words = {w.lower() for w in _WORDS.findall(label)}
                if words & AWAY:
                    away = max(away, 2 if words <= AWAY | STRUCTURE else 1)
                near |= bool(words & NEAR)
                sign |= bool(words & SIGNS)
    return away, near and not away, sign


class _Node:
    __slots__ = ("away", "content", "doubt", "link", "path", "sign", "tag")

    def __init__(self, tag: str, parent: "_Node | None", attributes: str, paths: "_Paths"):
        self.tag = tag
        away, near, sign = _marks(attributes) if attributes else (0, False, False)
        self.sign = sign or tag == "time"
        inside = parent is not None and parent.content
        if tag in ("html", "body", "article", "main"):
            away = 0
        if inside and away == 2 and tag not in CONTAINER and tag not in DROPPED and tag != "header":
            away = 0  # what a paragraph of an article is called doesn't make it something else
        if away == 1 and not (tag in CONTAINER and inside):  # in doubt: a container outside of articles goes, a paragraph stays
            away = 2 if tag in CONTAINER else 0
        self.content = inside or tag in CONTENT or (near and tag in ("div", "section", "td"))
        self.away = (parent is not None and parent.away) or tag in DROPPED or away == 2 or (tag in ("header", "label") and not inside)
        self.doubt = away == 1 or (parent is not None and parent.doubt)
        self.link = tag == "a" or (parent is not None and parent.link)
        self.path = paths.below(parent.path if parent else -1, (tag, away, near), self)


class _Paths:
    """The trie of tag paths: parents and a node of each; a path's number is greater than its parent's."""

    def __init__(self):
        self.parent, self.depth, self.node, self.numbers = [], [], [], {}
        self.opened, self.signs = [], []  # elements of each path, and those that name an author or a date

    def below(self, parent: int, label: tuple, node: _Node) -> int:
        number = self.numbers.setdefault((parent, label), len(self.parent))
        if number == len(self.parent):
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
            self.node.append(node)
            self.opened.append(0)
            self.signs.append(0)
        self.opened[number] += 1
        self.signs[number] += node.sign
        return number


class _Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self, root: _Node):
        self.stack, self.places, self.walls, self.limits = [root], {}, [0], [0]

    def push(self, node: _Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK and node.tag != "p":
            self.walls.append(len(self.stack))
        if node.tag in LIMITS:
            self.limits.append(len(self.stack))
        self.stack.append(node)

    def pop(self) -> None:
        node, at = self.stack.pop(), len(self.stack)
        self.places[node.tag].pop()
        for kept in (self.walls, self.limits):
            if kept[-1] == at:
                kept.pop()

    def close(self, tag: str, above: int) -> None:
        """Closes the last open element of this tag, and all in it, if it stands above the place."""
        places = self.places.get(tag)
        if places and places[-1] > above:
            at = places[-1]
            while len(self.stack) > at:
                self.pop()


def text_nodes(page: str) -> tuple[list[tuple[_Node, int, str]], _Paths]:
    """(node, block number, decoded text) of the text of the page, in order, and the trie of their paths."""
    paths = _Paths()
    open_, block, out, at, endless = _Open(_Node("", None, "", paths)), 0, [], 0, set()

    def emit(raw: str) -> None:
        if raw:
            out.append((open_.stack[-1], block, entities.unescape(raw)))

    m = _TOKEN.search(page, 0)
    while m:
        emit(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if tag in BLOCK:
            block += 1
        if tag and m[1]:
            open_.close(tag, 0 if tag in BLOCK else open_.walls[-1])  # an inline end tag doesn't close blocks
        elif tag:
            if tag in BLOCK:
                while len(open_.stack) > 1 and open_.stack[-1].tag in CLOSED_BY_BLOCK and open_.places.get("p"):
                    open_.pop()
                for other in SAME_CLOSES.get(tag, "").split():
                    open_.close(other, open_.limits[-1])
            if tag == "br":
                emit(" ")
            elif tag in RAW:
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style", "textarea", "title", "xmp"):
                    at = len(page)
                else:
                    endless.add(tag)
                    open_.push(_Node(tag, open_.stack[-1], m[3], paths))
            elif tag not in VOID:  # HTML ignores the slash of a self-closing tag
                open_.push(_Node(tag, open_.stack[-1], m[3], paths))
        m = _TOKEN.search(page, at)
    emit(page[at:])
    return out, paths


def threads(paths: _Paths, weight: list[int], most: float = 0.7) -> list[bool]:
    """Which paths lie in a thread of contributions: elements side by side, several of them, with an author or a date in each.

    A page that has little else, and no article beside it, is a thread itself and keeps its text."""
    n = len(weight)
    signs, below = list(paths.signs), list(weight)
    for i in range(n - 1, 0, -1):
        signs[paths.parent[i]] += signs[i]
        below[paths.parent[i]] += below[i]
    article = [False] * n
    for i in range(n):
        article[i] = paths.node[i].tag in CONTENT or (paths.parent[i] >= 0 and article[paths.parent[i]])

    def at_most(share: float) -> list[bool]:
        found = [False] * n
        for i in range(1, n):
            item = paths.opened[i] >= 2 and paths.node[i].tag in ITEMS and paths.opened[i] > paths.opened[paths.parent[i]] and signs[i] >= paths.opened[i]
            found[i] = found[paths.parent[i]] or (item and below[i] <= share * below[0])
        return found

    found = at_most(1.0)
    return found if any(w and a and not f for w, a, f in zip(weight, article, found, strict=True)) else at_most(most)


def path_scores(nodes: list[tuple[_Node, int, str]], paths: _Paths, blend: float = 0.5) -> list[float]:
    """The fused, smoothed score of each tag path; 0 for those without text."""
    n = len(paths.parent)
    stats = [[0.0] * n for _ in range(4)]  # nodes, characters, punctuation marks, characters of links
    count, length, marks, links = stats
    for node, _, text in nodes:
        stripped = text.strip()
        if stripped:
            p = node.path
            count[p] += 1
            length[p] += len(stripped)
            marks[p] += len(_PUNCTUATION.findall(stripped))
            links[p] += len(stripped) * node.link
    below = [[0.0 if paths.node[i].away else s[i] for i in range(n)] for s in stats]
    for i in range(n - 1, 0, -1):  # children have greater numbers
        for s in below:
            s[paths.parent[i]] += s[i]
    scores = [0.0] * n
    for i in range(n):
        node = paths.node[i]
        if count[i] and not node.away:
            up = max(0, paths.parent[i])
            ratio = (1 - blend) * length[i] / count[i] + blend * below[1][up] / below[0][up]
            dots = (1 - blend) * marks[i] / count[i] + blend * below[2][up] / below[0][up]
            scores[i] = (ratio * (1 + dots)) ** 0.5 * (1 - links[i] / length[i]) * (2.0 if node.content else 1.0) * (0.5 if node.doubt else 1.0)
    return scores


def main_text(page: str | None, share: float = 0.4, hold: float = 0.9) -> str:
    if not page:
        return ""
    nodes, paths = text_nodes(page)
    scores = path_scores(nodes, paths)
    n = len(scores)
    weight = [0] * n
    for node, _, text in nodes:
        if scores[node.path]:
            weight[node.path] += len(text.strip())
    if not sum(weight):
        return ""
    thread = threads(paths, weight)
    weight = [0 if t else w for w, t in zip(weight, thread, strict=True)]
    scores = [0.0 if t else s for s, t in zip(scores, thread, strict=True)]
    total = sum(weight)
    if not total:
        return ""
    least = share * sum(s * w for s, w in zip(scores, weight, strict=True)) / total
    chosen = [w > 0 and s >= least for s, w in zip(scores, weight, strict=True)]
    held = [w if c else 0 for w, c in zip(weight, chosen, strict=True)]
    holds = [False] * n  # is there a chosen path below?
    for i in range(n - 1, 0, -1):
        held[paths.parent[i]] += held[i]
        holds[paths.parent[i]] |= held[i] > 0
    best = max((i for i in range(n) if holds[i] and held[i] >= hold * held[0]), key=lambda i: paths.depth[i], default=0)  # the deepest container with nearly all of the chosen text
    under = [False] * n
    article = [False] * n
    for i in range(n):
        up = paths.parent[i]
        under[i] = i == best or (up >= 0 and under[up])
        article[i] = paths.node[i].tag in CONTENT or (up >= 0 and article[up])
    own = sum(w for w, c, a in zip(weight, chosen, article, strict=True) if c and a)
    marked = 2 * own >= sum(w for w, c in zip(weight, chosen, strict=True) if c) > 0  # most of it stands in an article's own element

    def inside(node: _Node) -> bool:
        if thread[node.path] or (marked and not article[node.path]):
            return False
        lent = node.content if marked else under[node.path] and paths.depth[best] > 1
        return chosen[node.path] or (lent and not node.doubt)

    # blocks with text of their own that is kept: what stands in them inline, link text too, belongs to that text
    spoken = {block for node, block, text in nodes if text.strip() and scores[node.path] and inside(node)}
    blocks: dict[int, list[str]] = {}
    for node, block, text in nodes:
        if node.away or thread[node.path]:
            continue
        if block in spoken or (inside(node) and (not text.strip() or (node.link and node.content))):
            blocks.setdefault(block, []).append(text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text, the main text of html, and n_chars, its code points; other columns pass through."""
    pages = pages.drop(*{"text", "n_chars"} - {html})
    at = pages.columns.index(html)
    added = ["text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [main_text(p) for p in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names, *added])
        release()

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields), "text string", "n_chars long"])
    return pages.mapInArrow(run, fields)
