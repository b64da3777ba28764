"""HTML main text by composite text density.

Every DOM node has a density: its characters per tag, adjusted for links (a node whose characters
are link text counts for little).  A node's density sum adds its children's densities; the node with
the largest sum is the main content.  The smallest density on the path from the body to it is the
threshold: from the body down, every node of at least that density contributes its own subtree of
largest sum.  A selection inside one ``article`` or ``main`` element takes all of that element.

Elements that never hold an article's text are left out beforehand: scripts, styles, forms, menus,
headers, footers and sidebars by tag or role, adverts, notices and reader comments by class or id.
What follows has-, no- or with- in a class name doesn't count, and inside an article only names made of
such words alone do.  A form, or an element with such a name, stays if it holds an article, a main or
most of the page's text outside links; a page that would have no text is read again without names.  Inside
an ``article`` or ``main`` taken whole, blocks that are lists of links by their densities are left out too:
three links or more that hold three quarters of the characters (unless links are half of it all); what was
selected beside one that has most of it goes, but for a first heading.
Character references are decoded; white space in a block becomes one space; blocks are trimmed and
joined in page order by one space.  Null, empty and text-less pages give an empty text.  Every page is
handled whole and by itself, in time and memory in proportion to it however its tags nest or stay open;
repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import column_name, extended, map_batches

_TOKEN = re.compile(
    r"<[!?][^>]*>"
    r"|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[^\W\d_]+")

# HTML element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "script style noscript template iframe object embed svg canvas audio video map head title nav footer aside button select textarea input dialog menu".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert status note menu menubar toolbar".split())
#: Words of class names and ids that mark adverts, notices, page furniture and reader comments.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus discussion "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pagination pager popup promo promoted "
    "promotion rail related recommended replies reply respond responses share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar widget "
    "anzeige anzeigen werbung publicité publicite publicidad anuncio anuncios hinweis aviso kommentar kommentare commentaire commentaires comentario "
    "comentarios réactions reactions leserbriefe".split()
)
#: Beginnings of names written as one word, and words, that mark an advert whatever stands beside them.
ADVERT_NAMES = ("adsby", "adsense", "adserver", "adslot", "adspace", "adspot", "adbox", "adunit", "adwrap")
ADVERTS = frozenset("ad ads advert adverts advertisement advertising outbrain taboola anzeige anzeigen werbung publicité publicite publicidad anuncio anuncios".split())
#: In a class name, what follows says how the page is laid out, not what the element is.
MODIFIERS = frozenset("has is no non not with without".split())
#: Of these, the names of an article's own parts, and those of readers' words, which may be longer than the article.
OF_ARTICLES = frozenset("banner discussion header notice notices".split())
OF_READERS = frozenset(
    "comment comments discussion disqus replies reply respond responses kommentar kommentare commentaire commentaires comentario comentarios réactions reactions "
    "leserbriefe".split()
)
#: A thread is the readers' own if one of these words stands beside it.
READERS = frozenset("user users reader readers visitor visitors".split())
#: Words that may stand beside them in a name that marks an article's boilerplate: "related-posts", not "related-work".
FURNITURE = frozenset(
    "area articles bar block bottom box btn button buttons container content desktop group icons inline inner item items left link links list media mobile "
    "outer page post posts right section site slot stories text top unit wrap wrapper".split()
)
#: Why an element is left out: never an article's text, or unless it holds the article.
ALWAYS, BY_NAME, BY_READERS = 1, 2, 3
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: A start tag ends open elements of these names, up to an enclosing element of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


class _Tree:
    """Nodes in page order: tag, parent, whether left out; and text pieces with the node they stand in."""

    def __init__(self, page: str, names: bool = True):
        self.tag, self.parent, self.out = ["html"], [-1], [False]
        self.why, self.content = [0], [False]
        self.linked = [False]
        self.pieces: list[tuple[int, str]] = []  # a None text is a block boundary
        # Open elements; the places of each name and of all that aren't inline, so that no tag walks them.
        self.stack, self.places, self.blocks = [0], {"html": [0]}, [0]
        self._read(page)
        self._spare(names)

    def _read(self, page: str) -> None:
        at, n, last = 0, len(page), page.rfind(">")
        cdata = page.rfind("]]>")
        while at < n:
            start = page.find("<", at)
            while start >= 0 and start < last and (start + 1 >= n or not (page[start + 1].isalpha() or page[start + 1] in "/!?")):
                start = page.find("<", start + 1)
            if start >= 0 and page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                found, stop = None, n if end < 0 else end + 3
            elif start < 0 or start > last:  # no tag ends after this
                self._text(self.stack[-1], page[at:])
                break
            elif page.startswith("<![CDATA[", start) and start < cdata:
                found, stop = None, page.find("]]>", start) + 3
            else:
                found = _TOKEN.match(page, start)
                stop = found.end() if found else start + 1
            if start > at:
                self._text(self.stack[-1], page[at:start])
            if found is None:
                if stop == start + 1:  # a "<" that starts nothing
                    self._text(self.stack[-1], "<")
                at = stop
                continue
            at = stop
            closing, opening = found.group(1), found.group(2)
            if opening:
                name = opening.lower()
                self._implied(name)
                if name not in INLINE:
                    self.pieces.append((self.stack[-1], None))
                if name in VOID:
                    self._node(name, self.stack[-1], 0)
                    continue
                article = bool(self.places.get("article") or self.places.get("main"))
                node = self._node(name, self.stack[-1], self._left_out(name, found.group(3), article))
                if name == "main" or name == "article" and not _boilerplate(found.group(3), False):
                    self.content[node] = True
                if name in RAW:
                    end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at) if at <= last else None
                    at = end.end() if end else n
                    continue
                if not found.group(0).endswith("/>") or name in INLINE or name in CLOSES_PARAGRAPH:
                    self._open(node, name)
            elif closing:
                name = closing.lower()
                if name not in INLINE:
                    self.pieces.append((self.stack[-1], None))
                place = self._place(name)
                # A stray inline end tag doesn't close blocks.
                if place > 0 and (name not in INLINE or place > self.blocks[-1]):
                    self._close(place)

    def _open(self, node: int, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def _close(self, place: int) -> None:
        """Close the open element at this place, and all in it."""
        while len(self.stack) > place:
            name = self.tag[self.stack.pop()]
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()

    def _place(self, name: str) -> int:
        """Place of the innermost open element of this name, -1 without any."""
        places = self.places.get(name)
        return places[-1] if places else -1

    def _spare(self, names: bool) -> None:
        """Leave out elements by name and forms, but those that hold the page's article."""
        if not any(w in (BY_NAME, BY_READERS) for w in self.why):
            return
        n = len(self.tag)
        plain = [0] * n
        for node, text in self.pieces:
            if text and not self.linked[node]:
                plain[node] += len("".join(text.split()))
        holds = list(self.content)
        for i in range(n - 1, 0, -1):
            if not self.out[i]:
                plain[self.parent[i]] += plain[i]
                holds[self.parent[i]] |= holds[i]
        for i in range(1, n):
            spared = not names or holds[i] or self.why[i] == BY_NAME and 2 * plain[i] > plain[0]
            self.out[i] = self.out[i] or self.out[self.parent[i]] or self.why[i] in (BY_NAME, BY_READERS) and not spared
        self.pieces = [(node, text) for node, text in self.pieces if text is None or not self.out[node]]

    def _node(self, name: str, parent: int, why: int) -> int:
        self.tag.append(name)
        self.parent.append(parent)
        self.why.append(why)
        self.content.append(False)
        self.out.append(self.out[parent] or why == ALWAYS)
        self.linked.append(name == "a" or self.linked[parent])
        return len(self.tag) - 1

    def _text(self, node: int, text: str) -> None:
        if not self.out[node]:
            self.pieces.append((node, html.unescape(text) if "&" in text else text))

    def _implied(self, name: str) -> None:
        if name in CLOSES_PARAGRAPH and self.tag[self.stack[self.blocks[-1]]] == "p":
            self._close(self.blocks[-1])
        if name in ENDS:
            ended, limit = (max(map(self._place, names)) for names in ENDS[name])
            if ended > max(limit, 0):
                self._close(ended)

    @staticmethod
    def _left_out(name: str, attributes: str, in_article: bool) -> int:
        if name in DROPPED or (name == "header" and not in_article):
            return ALWAYS
        if not attributes or name in ("html", "body", "main", "article"):
            return BY_NAME if name == "form" else 0
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                return ALWAYS
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return ALWAYS
        return _boilerplate(attributes, in_article) or (BY_NAME if name == "form" else 0)


@functools.lru_cache(maxsize=4096)
def _parts(word: str) -> tuple[str, ...]:
    """A compound such as "commentlist" as its two words."""
    if word not in BOILERPLATE:
        for cut in range(4, len(word) - 2):
            if word[:cut] in BOILERPLATE and word[cut:] in FURNITURE:
                return word[:cut], word[cut:]
    return (word,)


def _boilerplate(attributes: str, in_article: bool) -> int:
    """Whether class or id name an element that is left out."""
    found = 0
    for key, *values in _ATTRIBUTE.findall(attributes or ""):
        if key.lower() not in ("class", "id"):
            continue
        for token in "".join(values).lower().split():
            words = [part for w in _WORDS.findall(token) for part in _parts(w)]
            words = words[:next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))]
            if READERS.intersection(words) and {"thread", "threads"}.intersection(words):
                return BY_READERS
            marks = [w for w in words if (w in BOILERPLATE or w.startswith(ADVERT_NAMES)) and not (in_article and w in OF_ARTICLES)]
            if any(w in ADVERTS or w.startswith(ADVERT_NAMES) for w in marks):
                found = BY_NAME
                continue
            if not marks or in_article and any(w not in marks and w not in FURNITURE for w in words):
                continue
            if OF_READERS.intersection(marks):
                return BY_READERS
            found = BY_NAME
    return found


def densities(tree: _Tree) -> tuple[list[float], list[float], list[bool], list[float]]:
    """Composite density and density sum of every node, which are lists of links, and the links' part of the characters."""
    n = len(tree.tag)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in tree.pieces:
        if text:
            size = len("".join(text.split()))
            chars[node] += size
            if tree.linked[node]:
                links[node] += size
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        if tree.out[i]:
            continue
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (tree.tag[i] == "a")
    share = links[0] / chars[0] if chars[0] else 0.0
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        c = chars[i]
        if not c or tree.out[i]:
            continue
        t, lc, lt = max(tags[i], 1), max(links[i], 1), max(link_tags[i], 1)
        base = math.log(c / max(c - links[i], 1) * lc + share * c + math.e)
        density[i] = c / t * max(math.log(max(c / lc * t / lt, 1.0)) / math.log(base), 0.0)
        # A node of one character still is text.
        density[i] = max(density[i], 1e-9)
    for i in range(1, n):
        if not tree.out[i]:
            total[tree.parent[i]] += density[i]
    share_of_links = [links[i] / chars[i] if chars[i] else 0.0 for i in range(n)]
    lists = [link_tags[i] >= 3 and share_of_links[i] >= 0.75 and tree.tag[i] not in INLINE for i in range(n)]
    return density, total, lists, share_of_links


def main_text(page: str | None) -> str:
    """The page's main text; see the module's docstring."""
    if not page:
        return ""
    tree = _Tree(page)
    found = _chosen_text(tree)
    if not found and any(w in (BY_NAME, BY_READERS) for w in tree.why):
        found = _chosen_text(_Tree(page, names=False))
    return found


def _chosen_text(tree: _Tree) -> str:
    density, total, lists, share_of_links = densities(tree)
    n = len(tree.tag)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        if not tree.out[i]:
            children[tree.parent[i]].append(i)
    # Best node of each subtree, from the leaves up; on equal sums the outer, then the earlier one.
    value = [max(total[i], density[i] if not children[i] else 0.0) for i in range(n)]
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        if not tree.out[i] and value[best[i]] > value[best[p]]:
            best[p] = best[i]
        elif not tree.out[i] and best[p] != p and value[best[i]] == value[best[p]]:
            best[p] = best[i]
    body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    if tree.out[body] or not density[body]:
        body = 0
    threshold, i = density[best[body]], best[body]
    while i >= 0:
        threshold = min(threshold, density[i])
        if i == body:
            break
        i = tree.parent[i]
    chosen = [False] * n
    todo = [body]
    while todo:
        i = todo.pop()
        if density[i] >= threshold and density[i] > 0:
            j = best[i]
            chosen[j] = True
            if j == i:
                continue
        todo += [c for c in children[i] if not chosen[c]]
    # Nodes below a chosen one are chosen; a selection in one article or main takes all of it.
    home = [0] * n
    for i in range(n):
        p = tree.parent[i]
        outer = home[p] if p >= 0 else 0
        home[i] = outer or (i if tree.tag[i] in ("article", "main") else 0)
    homes = {home[i] for i in range(n) if chosen[i]}
    if homes - {0}:
        # What stands beside an article that has most of it isn't part of it, but for a heading of the page.
        size, below = [0, 0], chosen.copy()
        for i in range(1, n):
            below[i] = below[i] or below[tree.parent[i]]
        for node, text in tree.pieces:
            if text and (below[node] or home[node] and home[node] in homes):
                size[home[node] > 0] += len("".join(text.split()))
        if size[1] >= size[0]:
            chosen = [below[i] and tree.tag[i] == "h1" or chosen[i] and home[i] > 0 for i in range(n)]
    whole = [False] * n
    for i in homes - {0}:
        chosen[i], whole[i] = True, share_of_links[i] < 0.5
    for i in range(1, n):
        above = tree.parent[i]
        whole[i] = whole[i] or whole[above]
        chosen[i] = chosen[above] and not (whole[above] and lists[i]) or chosen[i] and not (whole[above] and not chosen[above])
    blocks, run = [], []
    for node, text in tree.pieces:
        if text is None:
            if run:
                blocks.append(" ".join("".join(run).split()))
                run = []
        elif chosen[node]:
            run.append(text)
    blocks.append(" ".join("".join(run).split()))
    return " ".join(b for b in blocks if b)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with text and n_chars instead of ``column``; clashing names get an underscore."""
    rest = pages.drop(column)
    names = [column_name(rest, "text"), column_name(rest, "n_chars")]
    schema = extended(rest, (names[0], "string"), (names[1], "long"))

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in schema])

    return map_batches(pages.select(*rest.columns, column), run, schema)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
