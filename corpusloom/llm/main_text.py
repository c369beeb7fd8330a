"""Main text of HTML pages by tree scoring.

A page is read once into blocks of text and the tree of its block elements. Each paragraph gives points for
length and commas, discounted by its links, to the element that holds it and half as much to each element
further out. Discounted by its own share of links, the best container is the main text, with those of its siblings that
read like it. Menus, headers and footers of the page, sidebars, notices, adverts, forms and readers'
comments are taken out wherever they stand, by element, role or the words of class and id.

The tree is kept in flat lists and walked without recursion; time and memory are linear in the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

# Names of elements and words of markup.
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul".split()
)
PARAGRAPHS = frozenset("p pre blockquote li td dd h1 h2 h3 h4 h5 h6 figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Not containers of a main text themselves.
LEAVES = PARAGRAPHS - {"td"}
LISTS = frozenset("ul ol dl table menu dir".split())
DROPPED = frozenset("head nav aside footer form menu search dialog script style noscript iframe template svg object canvas audio video select option button textarea label input datalist title".split())
WRAPPERS = frozenset("form aside".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot alert alerts banner banners breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus discussion feedback footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promos promotion recommended recommendations related replies reply respond responses share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription taboola toolbar topbar widget widgets".split()
)
#: A class or id that begins so says what a wrapper goes with, not what it is.
WITH = frozenset("has with no without js is".split())
KEPT = frozenset("article main".split())
GOOD = frozenset("article articlebody body content entry main post story text".split())
#: One of these as a whole class name tells that the other names of the list only qualify.
PLAIN = frozenset("article content entry main post story".split())
#: An end tag of an open element on the left is implied by a start tag on its right.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Beyond the innermost of these an implied end tag does not reach.
WALLS = ("ul", "ol", "dl", "table", "article", "section", "div", "main", "aside", "nav", "form", "blockquote")

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # comments
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*+>?+|</(?![a-zA-Z])[^>]*+>?+"  # declarations and what browsers read as comments
    r"|<(/?+)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"?+|'[^']*+'?+)?+)*+)(>?+)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)\s*+(?:=\s*+(?:\"([^\"]*+)|'([^']*+)|([^\s>]++))?+)?+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
COMMAS = re.compile("[,،、，﹐;]")

#: Points: a full measure of length, and what an element keeps of the points of those in it.
LENGTH, DECAY = 100, 0.5
#: A list with this share of linked text and two or more links is a menu.
LINKED = 0.6
#: A single block needs so many links for that.
LINKS = 3
#: A sibling stays if its score is this part of the best one's.
SIBLING = 0.2


class Page:
    """Blocks of text and the tree of block elements of one page."""

    def __init__(self, source: str):
        self.tag, self.parent, self.flag, self.good, self.head = ["html"], [-1], [False], [0], [False]
        self.blocks: list[tuple[int, str, int, int]] = []  # (element, text, linked code points, links)
        self.stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # name, element, is a link
        self.open: dict[str, list[int]] = {"html": [0]}  # places in the stack by name
        self.texts: list[str] = []
        self.linked, self.links, self.in_link, self.breaks = 0, 0, 0, 0
        self._read(source)
        self._flush()

    # reading

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            lt = source.find("<", at)
            if lt < 0:
                self._text(source[at:])
                return
            if lt > at:
                self._text(source[at:lt])
            found = TOKEN.match(source, lt)
            if not found:  # a bare "<"
                self._text("<")
                at = lt + 1
                continue
            at = found.end()
            name = found[2]
            if name is None:
                if found[0].startswith("<![CDATA["):
                    self._text(found[0][9:].removesuffix("]]>"), False)
                continue
            if not found[4]:  # cut off inside a tag
                return
            name = name.lower()
            if found[1]:
                self._end(name)
            else:
                closed = self._start(name, found[3])
                if name in RAW and not closed:
                    at = self._raw_end(source, at, name)

    @staticmethod
    def _raw_end(source: str, at: int, name: str) -> int:
        """Where the text of a script and the like ends; the end tag itself is read as others are."""
        found = None if name == "plaintext" else re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
        return found.start() if found else len(source)

    def _text(self, text: str, references: bool = True) -> None:
        if references and "&" in text:
            text = html.unescape(text)
        self.texts.append(text)
        if self.in_link:
            self.linked += len(text.strip())
        if self.breaks and not text.isspace():
            self.breaks = 0

    def _flush(self) -> None:
        if self.texts:
            text = " ".join("".join(self.texts).split())
            if text:
                self.blocks.append((self.stack[-1][1], text, self.linked, self.links))
            self.texts = []
        self.linked = self.links = self.breaks = 0

    def _start(self, name: str, attributes: str) -> bool:
        if name == "br":  # one is white space, two are the end of a block
            self.breaks += 1
            self.texts.append(" ")
            if self.breaks == 2:
                self._flush()
            return True
        if name in ("html", "body") and name in self.open:
            return True
        unlikely, good, head = self._judged(name, attributes)
        if name in BLOCKS:
            self._flush()
            self._close_implied(name)
        elif unlikely:
            self._flush()
        if name in VOID:
            return True
        if name == "a" and self.open.get("a"):  # links do not nest
            self._pop_to(self.open["a"][-1])
        if name in BLOCKS or unlikely:
            self.tag.append(name)
            self.parent.append(self.stack[-1][1])
            self.flag.append(unlikely)
            self.good.append(good)
            self.head.append(head)
            element = len(self.tag) - 1
        else:
            element = self.stack[-1][1]
        link = name == "a"
        self.in_link += link
        self.links += link
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, element, link))
        return False

    def _close_implied(self, name: str) -> None:
        p = self.open.get("p")
        if p:
            self._pop_to(p[-1])
        if name in HEADINGS:
            for h in HEADINGS:
                if self.open.get(h):
                    self._pop_to(self.open[h][-1])
        ends = IMPLIED.get(name, ())
        if ends:
            wall = max((self.open[w][-1] for w in WALLS if self.open.get(w)), default=-1)
            if name in ("td", "th", "tr"):
                wall = self.open["table"][-1] if self.open.get("table") else -1
            first = min((self.open[e][-1] for e in ends if self.open.get(e) and self.open[e][-1] > wall), default=None)
            if first is not None:
                self._pop_to(first)

    def _end(self, name: str) -> None:
        places = self.open.get(name)
        if not places:
            if name in ("p", "br"):
                self._flush()
            return
        if name not in BLOCKS:  # an inline end tag does not end a block around it
            wall = max((self.open[w][-1] for w in ("p", "td", "li", *WALLS) if self.open.get(w)), default=-1)
            if places[-1] < wall:
                return
        elif name in ("p", "li", "dt", "dd"):
            wall = max((self.open[w][-1] for w in WALLS if self.open.get(w)), default=-1)
            if places[-1] < wall:
                return
        self._pop_to(places[-1])

    def _pop_to(self, place: int) -> None:
        """Ends what stands in the stack from a place on."""
        inner = self.stack[-1][1]
        outer = self.stack[place - 1][1] if place else 0
        if inner != outer:
            self._flush()
        while len(self.stack) > max(1, place):
            name, _, link = self.stack.pop()
            self.open[name].pop()
            self.in_link -= link

    def _judged(self, name: str, attributes: str) -> tuple[bool, int, bool]:
        """Whether an element looks like no part of the main text, like its container, like a header."""
        unlikely, good, head = name in DROPPED, int(name in KEPT), name == "header"
        if attributes and not attributes.isspace():
            for key, *values in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), next((v for v in values if v), "")
                if key in ("class", "id"):
                    parts = [[w.lower() for w in WORD.findall(part)] for part in value.split()]
                    plain = any(len(words) == 1 and words[0] in PLAIN for words in parts)
                    for words in parts:
                        if words and words[0] not in WITH:
                            fine = not GOOD.isdisjoint(words)
                            unlikely |= not plain and name not in ("html", "body", "main") and not WORDS.isdisjoint(words)
                            head |= not fine and name != "body" and "header" in words
                            good |= 2 * fine
                elif key == "role":
                    unlikely |= not ROLES.isdisjoint(value.lower().split())
                    good |= value.lower() in ("main", "article")
                elif key == "itemprop":
                    good |= value.lower() == "articlebody"
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    unlikely |= name not in ("html", "body")
        return bool(unlikely), int(good), bool(head)

    # judging

    def main_text(self) -> str:
        return self._best(self._excluded(True)) or self._best(self._excluded(False))

    def _best(self, out: list[bool]) -> str:
        n = len(self.tag)
        kept = [b for b in self.blocks if not out[b[0]] and not (b[3] >= LINKS and b[2] >= LINKED * len(b[1]))]
        if not kept:
            return ""
        chars, linked, links, score = [0] * n, [0] * n, [0] * n, [0.0] * n
        for element, text, own, number in kept:
            size = len(text)
            chars[element] += size
            linked[element] += min(own, size)
            links[element] += number
            score[element] += self._points(element, text, min(own, size))
        for k in range(n - 1, 0, -1):  # what stands in an element has a larger number
            up = self.parent[k]
            chars[up] += chars[k]
            linked[up] += linked[k]
            links[up] += links[k]
            # a paragraph hands all its points to the element that holds it, others a part
            score[up] += score[k] * (1.0 if self.tag[k] in PARAGRAPHS else DECAY)
        menu = [False] * n
        for k in range(1, n):
            menu[k] = menu[self.parent[k]] or (self.tag[k] in LISTS and links[k] > 1 and linked[k] >= LINKED * max(1, chars[k]))
        final = [0.0] * n
        best = 0
        for k in range(n):
            if out[k] or menu[k] or self.tag[k] in LEAVES or not chars[k]:
                continue
            final[k] = score[k] * (1 - linked[k] / chars[k]) * (1 + 0.5 * (self.good[k] > 0) + 0.5 * (self.good[k] & 1))
            if final[k] > final[best]:
                best = k
        line, k = {best: 0}, best  # the elements around the best one
        while self.parent[k] >= 0:
            line[self.parent[k]] = k
            k = self.parent[k]
        take = [False] * n
        take[best] = True
        for k in range(1, n):
            up = self.parent[k]
            # what stands in a taken element is taken, and so are siblings, and the title above the best or an element around it
            take[k] = take[k] or take[up]
            if not take[k] and not menu[k] and up in line and up != best:
                take[k] = up == self.parent[best] and self._sibling(k, best, chars, linked, final, score) or self.tag[k] == "h1" and k < line[up]
        return "\n\n".join(text for element, text, _, _ in kept if take[element] and not menu[element])

    def _points(self, element: int, text: str, own: int) -> float:
        if self.tag[element] in HEADINGS:
            return 0.0
        size = len(text)
        return (min(1.0, size / 25) + size / LENGTH + len(COMMAS.findall(text))) * (1 - own / size)

    def _sibling(self, k: int, best: int, chars: list[int], linked: list[int], final: list[float], score: list[float]) -> bool:
        """A sibling stays if it is a heading above, prose without many links, or scores like the best; a section beside
        a section, and what stands in an element that names itself content, needs some prose only."""
        if not chars[k] or linked[k] > 0.25 * chars[k]:
            return False
        if self.tag[k] in HEADINGS or self.tag[k] in ("header", "hgroup"):
            return k < best
        if self.tag[k] in LEAVES:
            return True
        if self.good[self.parent[k]] or self.tag[k] == self.tag[best] == "section":
            return score[k] > 0
        return final[k] >= SIBLING * final[best]

    def _excluded(self, by_name: bool) -> list[bool]:
        """Elements that are no part of the main text. A wrapper that looks so, but holds the article or main
        part, is none; a header inside an article is the article's own."""
        n = len(self.tag)
        flag = self.flag if by_name else [t in DROPPED for t in self.tag]
        inside, holds, out = [False] * n, [False] * n, [False] * n
        for k in range(n - 1, 0, -1):
            holds[k] = holds[k] or not flag[k] and self.good[k] & 1 == 1
            if holds[k]:
                holds[self.parent[k]] = True
        for k in range(1, n):
            up = self.parent[k]
            inside[k] = inside[up] or self.good[k] > 0 and not flag[k]
            hides = flag[k] and (self.tag[k] in DROPPED - WRAPPERS or not holds[k])
            out[k] = out[up] or hides or self.head[k] and not inside[up] and not holds[k]
        return out


def main_text(source: str) -> str:
    return Page(source).main_text()


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; rows are judged one by one, so ties and repeated rows stay as they are.

    Null or empty html, and a page without prose, give an empty text; nulls in other columns are kept, other
    columns ignored. A page is read as a whole: memory is linear in the longest one of a slice.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body", 2 << 20):
                texts = [main_text(x.decode("utf-8", "replace")) for x in part.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_bytes(html_col).alias("body"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
