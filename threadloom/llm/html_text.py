"""Main text of HTML pages by scoring the element tree.

Each page is tokenised once into blocks of text, every one with the path of elements it
stands in. Blocks that are paragraphs score points for their length and commas, discounted
by their share of link text; points go in full to the parent and in halves to each further
ancestor. Where ``article`` elements (or else ``main``) hold prose, the container with the most
points within them is the choice and its outermost ``article`` the root, whatever readers wrote
below it. Otherwise the root climbs from the best container to any ancestor that holds clearly
more prose at a low share of links. Kept are all blocks of
the root, and beside it paragraphs, headings, lists and containers that score well and are not
made of links. Blocks are joined in page order.

Elements that are never article text are left out before scoring. Tags, roles and ``hidden``
decide by themselves. Names (``class`` and ``id``, split at hyphens, underscores, digits and
camel case) decide unless the text speaks against them: a name of ``DOUBTFUL`` is overruled by
a long text without links, and so is one of ``UNLIKELY`` that goes on with other words than
those of ``LAYOUT`` (``related-work``, not ``related-posts``); any other one of ``UNLIKELY`` only if
the element holds most of the page's text. A header inside an article keeps its headings. A
heading like "3 Comments" ends the text of the element it stands in. Lists of links go, except
those under a heading in an article, such as its sources.

One pass over the rows without a shuffle; a task holds one page at a time, in time linear in
its length. The parser is lenient: unclosed and stray tags, missing ends, and attributes
without quotes are accepted.

Defined results: null and empty pages, and pages without text, give an empty text; of equal
scores the outermost, first element wins; ids and URLs may be null or repeat; an empty table
gives an empty table; columns other than the three named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$)", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|data-ads?(?:-[\w-]+)?)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACES = re.compile(r"\s+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Elements whose content is not parsed as markup.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "math", "iframe", "xmp"}
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
#: Elements that are never part of an article; the second set stands within lines of text.
DROPPED = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "head"}
DROPPED_INLINE = {"button", "select", "object", "canvas", "audio", "video", "label", "datalist", "meter", "progress"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that pass their points on to what they stand in.
PARAGRAPHS = {"p", "pre", "td", "th", "blockquote", "li", "dd", "dt"} | HEADINGS
LISTS = {"ul", "ol", "dl", "table", "figure", "details"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "legend", "li", "main", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | DROPPED
#: What an opening tag ends if it is open: a paragraph by any block, an item by the next one.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"ul", "ol", "dl", "table"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
#: Parts of names. Readers' comments; what is no article as a rule; what is none if it is short or made of links.
COMMENTS = set("comment comments commentlist commenter commenters reply replies disqus respond responses".split())
UNLIKELY = set(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle adslot sponsor sponsors sponsored promo promos promotion promoted breadcrumb breadcrumbs"
    " cookie cookies consent gdpr disclaimer disclaimers footer sidebar nav navbar navigation menu newsletter subscribe subscription pagination pager popup modal"
    " notice notices related recommended recommendations outbrain taboola toolbar paywall login signup thread threads feedback talk".split()
)
DOUBTFUL = set("header masthead social share sharing shares sharebar widget widgets alert alerts notification topbar follow tags logo".split())
#: Parts that say how something is laid out or shown, and so leave the sense of the others; they also follow others in one word.
LAYOUT = set(
    "area articles bar block block body bottom box button buttons card cards center column container content desktop footer form frame grid group head heading holder icon inner item items js label layer layout left"
    " link links list message middle mobile module outer overlay page pane panel post posts region right row section shell slot space stories story strip teaser text title top unit user users view wrap wrapper zone".split()
)
_JOINED = re.compile(rf"(?:ads?|advert|cookies?|gdpr|promo|sponsor|newsletter|comments?|nav|menu|side)(?:{'|'.join(sorted(LAYOUT))}|banner|notice|consent|popup|modal)s?")
#: Headings of readers' comments, and those of lists of links that are no part of the article.
_TALK = re.compile(
    r"(?:\d+ |all |reader |readers' |user |recent |view |show )*(?:comments?|responses?|replies|kommentare?|commentaires?|comentarios?|antworten|réponses|respuestas)(?: \(?\d+\)?| from readers)?:?"
    r"|(?:leave|post|add|write)(?: a| your)? (?:reply|comment|response)s?|join the (?:discussion|conversation)|what do you think\??", re.I
)
_ELSEWHERE = re.compile(r"related|more (?:stories|from|on|news|articles|posts)|read (?:more|next|also)|(?:you )?(?:may|might) also|recommended|popular|most read|latest|trending|tags|topics|categories|share|follow|menu|navigation|contents|archives?|sponsored|siehe auch|mehr|lire aussi|leer más", re.I)
#: Parts that turn the sense of a name: ``with-sidebar``, ``entry-header``.
_NEGATING = set("has with no not without is hide hidden".split())
_OWN = set("entry post article content story body main hentry".split())
_LEGAL = re.compile(r"©|\bcopyright\b|\ball rights reserved\b", re.I)
#: A block with fewer characters is no paragraph and passes no points; one with more is prose.
LEAST_CHARS = 25
PROSE_CHARS = 80
#: A name of ``DOUBTFUL`` holds for texts below this, one of ``UNLIKELY`` for parts below this share of the page.
LONG_CHARS = 140
MOST_SHARE = 0.6
#: Prose that an element of an ``UNLIKELY`` name must hold at least to be taken for a wrapper of the article.
WRAPPED_CHARS = 500
#: From what share of link text on an element counts as made of links.
LINKED = 0.25
#: How much more prose than the choice so far an ancestor must hold to take its place.
CLIMB = 1.2
#: A container beside the root is kept from this share of the root's points on.
SIBLING = 0.1


class _Node:
    __slots__ = ("tag", "parent", "name", "dropped", "kept", "score", "chars", "linked", "links", "prose", "legal", "title")

    def __init__(self, tag: str, parent: _Node | None, name: str, dropped: bool):
        self.tag, self.parent, self.name, self.dropped = tag, parent, name, dropped
        self.kept, self.score = False, 0.0
        self.clear()

    def clear(self) -> None:
        self.chars = self.linked = self.links = self.prose = self.legal = self.title = 0

    @property
    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


@lru_cache(maxsize=4096)
def _named(names: str) -> str:
    """What the names of an element say: ``comments``, ``unlikely``, ``banner``, ``doubtful`` or nothing."""
    said = ""
    tokens = [[x.lower() for x in _PART.findall(token)] for token in names.split()]
    own = any(len(parts) == 1 and parts[0] in _OWN for parts in tokens)
    for parts in tokens:
        held = set(parts)
        if held & _NEGATING:
            continue
        if held & COMMENTS and not own:
            return "comments"
        if held & UNLIKELY and (held - UNLIKELY) <= LAYOUT | DOUBTFUL or any(map(_JOINED.fullmatch, parts)):
            said = "unlikely"
        elif "banner" in held:
            said = said or "banner"
        elif held & UNLIKELY or held & DOUBTFUL and not held & _OWN:
            said = said or "doubtful"
    return said


def _attributes(attributes: str) -> tuple[str, bool]:
    """What an element's names say, and whether its role or ``hidden`` leaves it out."""
    names, out = [], False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or name.startswith("data-ad") or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            out = True
        elif name in ("class", "id"):
            names.append(value)
    return _named(" ".join(names)) if names else "", out


Block = tuple[str, int, int, _Node]


def _blocks(html: str) -> tuple[list[Block], list[_Node]]:
    """The text blocks in page order as (text, characters in links, links, element), and all elements."""
    root = node = _Node("", None, "", False)
    nodes, blocks = [root], []
    text: list[str] = []
    linked = links = in_link = at = 0
    articles = 0
    opened: dict[str, int] = {}
    #: An element within a line that is left out: its tag, how deep it is nested, and what it stands in.
    mute, depth, mute_node = "", 0, root

    def flush() -> None:
        nonlocal linked, links
        if text:
            own = _SPACES.sub(" ", unescape("".join(text))).strip()
            text.clear()
            if own and not node.dropped:
                blocks.append((own, min(linked, len(own)), links, node))
        linked = links = 0

    def leave(up: _Node) -> None:
        """Go on in the parent of the open element ``up``."""
        nonlocal node, in_link, mute, articles
        flush()
        while node is not up.parent:
            if node is mute_node:
                mute = ""
            articles -= node.tag in ("article", "main")
            opened[node.tag] -= 1
            node = node.parent
        in_link = 0

    def add(part: str) -> None:
        nonlocal linked
        if not node.dropped and not mute:
            text.append(part)
            linked += in_link * len(part)

    for match in iter(lambda: _TOKEN.search(html, at), None):
        if match.start() > at:
            add(html[at : match.start()])
        at = match.end()
        tag = match[2] or match[5]
        if not tag:
            if match.start() == match.end():
                break
            continue
        tag, attributes = tag.lower(), match[3] or match[6] or ""
        if match[1] or match[4]:
            if tag == mute:
                depth -= 1
                mute = mute if depth else ""
            elif tag == "a":
                in_link = 0
            elif tag in BLOCKS:
                flush()
                if opened.get(tag):
                    up = node
                    while up.tag != tag:
                        up = up.parent
                    leave(up)
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.start() if end else len(html)
        elif tag in BLOCKS:
            flush()
            ended = ENDS.get(tag, {"p"})
            up = node
            while up is not root and up.tag not in ended and (tag in ENDS and up.tag not in _SCOPES or up.tag == "p"):
                up = up.parent
            if up is not root and up.tag in ended:
                leave(up)
            if tag not in VOID:
                name, out = _attributes(attributes) if attributes else ("", False)
                if tag in DROPPED:
                    # Of a header in an article the headings stay: its other text is named "header".
                    out = out or tag != "header" or not articles
                    name = "header" if name in ("", "doubtful") else name
                if tag in ("html", "body", "main"):
                    name = ""
                inner = node.name == "header" and tag not in HEADINGS
                node = _Node(tag, node, "header" if inner else name, node.dropped or out)
                articles += tag in ("article", "main")
                opened[tag] = opened.get(tag, 0) + 1
                nodes.append(node)
        elif tag == "br":
            add(" ")
        elif tag == mute:
            depth += 1
        elif not mute and tag not in VOID and not attributes.endswith("/"):
            name, out = _attributes(attributes) if attributes else ("", False)
            if out or tag in DROPPED_INLINE or name:
                mute, depth, mute_node = tag, 1, node
            elif tag == "a":
                in_link, links = 1, links + 1
    if at < len(html):
        add(html[at:])
    flush()
    return blocks, nodes


def _left_out(blocks: list[Block], nodes: list[_Node]) -> None:
    """Drop elements by their names and headings, now that their texts are known."""
    around = {id(nodes[0])}  # what stands around an article
    for x in nodes:
        if x.tag in ("article", "main") and x.chars:
            while x is not None and id(x) not in around:
                around.add(id(x))
                x = x.parent
    titles: dict[int, str] = {}
    firsts: dict[int, _Node] = {}  # the first element with text of each element
    for own, _, _, node in blocks:
        if node.tag in HEADINGS:
            titles[id(node)] = own
        x = node
        while x.parent is not None and id(x.parent) not in firsts:
            firsts[id(x.parent)] = x
            x = x.parent
    before: dict[int, _Node] = {}  # the sibling before each element, by what they stand in
    talk: dict[int, str] = {}  # the rank of the heading after which readers speak
    inside = {id(nodes[0]): False}
    for x in nodes[1:]:
        up = id(x.parent)
        inside[id(x)] = inside[up] or x.tag in ("article", "main")
        title = titles.get(id(x), "")
        if title and _TALK.fullmatch(title):
            talk[up] = x.tag
            if firsts.get(up) is x and up not in around:
                x.parent.dropped = True
        elif title and up in talk and x.tag <= talk[up]:
            del talk[up]  # another part of the text begins
        headed = titles.get(id(before.get(up)), "")
        before[up] = x
        if x.parent.dropped or up in talk:
            x.dropped = True
        elif x.name == "doubtful":
            x.dropped = x.tag not in HEADINGS and (x.chars < LONG_CHARS or x.density >= LINKED)
        elif x.name == "banner":
            x.dropped = x.title < x.chars
        elif x.name == "unlikely":
            most = x.chars >= MOST_SHARE * nodes[0].chars and x.prose >= WRAPPED_CHARS and x.density < LINKED
            x.dropped = not most or len(around) > 1 and id(x) not in around
        elif x.name == "comments":
            x.dropped = True
        elif x.links > 2 and x.density > 0.8 and x.tag in ("ul", "ol", "dl", "div", "table", "section"):
            # A menu without a name, unless it is a headed list of the article.
            x.dropped = not (inside[id(x)] and headed and x.tag in LISTS and not _ELSEWHERE.match(headed))


def _count(blocks: list[Block], nodes: list[_Node]) -> None:
    """What the blocks of each element sum up to; elements come after those they stand in."""
    for x in nodes:
        x.clear()
    for own, linked, links, node in blocks:
        node.chars += len(own)
        node.linked += linked
        node.links += links
        node.prose += len(own) if len(own) >= PROSE_CHARS and linked < LINKED * len(own) else 0
        node.legal += len(own) < 200 and bool(_LEGAL.search(own))
        node.title += len(own) if node.tag in HEADINGS else 0
    for x in reversed(nodes[1:]):
        up = x.parent
        up.chars += x.chars
        up.linked += x.linked
        up.links += x.links
        up.prose += x.prose
        up.legal += x.legal
        up.title += x.title


def _score(blocks: list[Block]) -> None:
    for own, linked, _, node in blocks:
        if len(own) < LEAST_CHARS:
            continue
        points = (1 + own.count(",") + min(len(own) / 100, 3)) * (1 - linked / len(own))
        # A paragraph passes its points on; text directly in a container is that container's.
        up = node.parent if node.tag in PARAGRAPHS and node.parent else node
        while up is not None and points > 0.01:
            up.score += points
            up, points = up.parent, points / 2


def _within(nodes: list[_Node]) -> list[_Node]:
    """Where to look for the best container: in the articles, or else in ``main``, if these hold prose; or anywhere."""
    for tag in ("article", "main"):
        held = {id(x) for x in nodes if x.tag == tag and x.prose and not x.dropped and x.density < LINKED}
        if held:
            for x in nodes:
                if x.parent is not None and id(x.parent) in held:
                    held.add(id(x))
            return [x for x in nodes if id(x) in held]
    return nodes


def _root(best: _Node) -> _Node:
    """The element that holds the article of which ``best`` scores most."""
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    for tag in ("article", "main"):
        if own := [x for x in above if x.tag == tag]:
            return own[-1]
    root = best
    for x in above[1:]:
        if x.prose > CLIMB * root.prose and x.density < LINKED:
            root = x
    return root


def _beside(x: _Node, root: _Node) -> bool:
    """Whether a sibling of the root belongs to the article."""
    if x.dropped or x.density >= LINKED or not x.chars or x.legal:
        return False
    if x.title == x.chars:
        return True
    if root.tag in ("article", "main"):
        return x.tag == root.tag and x.score >= SIBLING * root.score
    return x.tag in PARAGRAPHS or x.tag in LISTS and x.chars >= LEAST_CHARS or x.score >= max(1.0, SIBLING * root.score)


def extract(html: str | None) -> str:
    """The main text of a page: its blocks joined by two line feeds."""
    blocks, nodes = _blocks(html or "")
    _count(blocks, nodes)
    _left_out(blocks, nodes)
    blocks = [b for b in blocks if not b[3].dropped and b[3].name != "header"]
    _count(blocks, nodes)
    _score(blocks)
    rated = lambda x: x.score * (1 - x.density)
    best = max(_within(nodes), key=rated)
    if rated(best) <= 0:  # without any paragraph all text stays
        return "\n\n".join(own for own, linked, _, _ in blocks if linked < len(own) / 2)
    root = _root(best)
    for x in nodes:
        x.kept = x is root or x.parent is not None and (x.parent.kept or x.parent is root.parent and _beside(x, root))
    return "\n\n".join(own for own, _, _, node in blocks if node.kept)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` for each row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array((extract(x.as_py()) for x in batch.column(2)), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=["page_id", "url", "text"])

    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")
