"""HTML extraction by wrappers: union-free regular expressions inferred for each host.

A page is a stream of tokens, tags and texts. The wrapper of a host starts as one of its
pages and is aligned with the token streams of all others, element by element. Where they
part, differing texts become text slots; elements that only some pages have become
optional; and a stretch that goes back to its own beginning, be it one element or several
(h2 p p h2 p), becomes a repeated group. What the wrapper has seen decides: each of its
items is article or chrome by its element, its names, how its text varies over the host's
pages, and how much of it is links. Every page is matched against its host's wrapper,
and the texts at article items are its text.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from html import unescape
from operator import attrgetter, itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequery.llm.common import SLICE_CHARS, durable, slices

#: Not used here, as wrappers are inferred from all pages of a host; a test of copies takes a number from it.
SAMPLE = 8
#: Pages of a host that one task aligns; wrappers of such parts are merged, so many at a time.
PART, FAN = 1_024, 64
#: Wording is template where at least so many different pages of a host hold it, and this share of them.
LEAST, SHARE = 3, 0.9
#: Bytes of all wrappers up to which they are broadcast; beyond, pages are shuffled to them, where a host takes so many pages a part.
BROADCAST, HOT = 8 << 20, 50_000
#: Elements nested deeper than this are read as standing at this depth; their text stays.
DEPTH = 128
#: Characters of a class, id, role or style that count.
NAMED = 200

#: Elements that hold no article text.
CHROME_TAGS = frozenset("nav header footer aside form menu dialog button fieldset head".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Elements whose contents are no text, up to their end tag.
_RAW = frozenset("script style noscript template textarea title svg iframe select object canvas math".split())
#: Names that mark chrome wherever they stand: adverts, reader comments, side bars, menus, consent and sign-up boxes.
STRONG = re.compile(
    r"(?:^|\s)(?:ads?|ad-\S+|\S+-ads?|adverts?|advertis\S+|sponsor(?:ed|s)?|(?:\S+-)?comments?(?:-\S+|list)?|disqus\S*|replies|responses|respond"
    r"|sidebar|side-bar|sidebar-\S+|\S+-sidebar|nav|navbar|navigation|\S+-nav|nav-\S+|menu|\S+-menu|menu-\S+|breadcrumbs?|pagination|pager"
    r"|cookies?|cookie-\S+|consent|\S+-consent|gdpr|popup|modal|overlay|newsletter|newsletter-\S+|subscribe|signup)(?=\s|$)"
)
#: Names that mark chrome outside the article, and inside it only where the host's pages bear them out.
WEAK = re.compile(
    r"(?:^|\s)(?:(?:site|page|top|bottom|global|main)-)?(banner|promo|promotion|header|masthead|topbar|footer|foot|side|rail|widget|notices?|alert|login|search|reply|related|recommended"
    r"|share|sharing|social|toolbar|skip|hidden|legal|copyright)(?:-(?:wrap|wrapper|container|bar|box|top|inner|area|links|list|block|section|panel|posts|articles|stories|text|\d+))?(?=\s|$)"
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu "
    "nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = BLOCKS - {"body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_ALIKE = {t: frozenset(g) for g in (("li",), ("dt", "dd"), ("tr",), ("td", "th")) for t in g}
#: Boxes that say nothing by themselves: without a name, their place among their like tells them apart.
_PLAIN = frozenset("div section table tbody td center".split())
#: Places of one plain box in a list that are told apart.
PLACES = 8

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LAX = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>")
_ENDS = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def tokens(html: str | None) -> list[tuple]:
    """("open", tag, attributes), ("close", tag) and ("text", words, all links) in page order.

    Comments, declarations and the contents of scripts, styles and the like are no
    tokens. Text runs on through inline elements; line breaks are white space. Inline
    elements count only where they are hidden or have a name. A tag without an end goes
    on to the end of the page; where quotes alone keep tags open to there, tags from
    then on end at the next mark, so the work grows with the page's length only.
    """
    out: list[tuple] = []
    text = html or ""
    size, last = len(text), (html or "").rfind(">")
    said, linked = [], [0, 0]  # pieces of text; characters in all, and in links
    link, at, pattern = False, 0, _TAG
    inline: list[str] = []  # open inline elements that are tokens

    def say(piece: str):
        if piece:
            said.append(piece)
            n = len(piece) - piece.count(" ")
            linked[0] += n
            linked[1] += n if link else 0

    def flush():
        if said:
            words = _SPACE.sub(" ", unescape("".join(said))).strip()
            if words:
                out.append(("text", words, linked[0] == linked[1]))
            said.clear()
            linked[:] = 0, 0

    while at < size:
        begin = text.find("<", at)
        if begin < 0:
            say(text[at:])
            break
        say(text[at:begin])
        mark = text[begin + 1 : begin + 2]
        if mark == "!" or mark == "?":
            if text.startswith("<!--", begin):
                end = text.find("-->", begin + 4)
                at = size if end < 0 else end + 3
            elif text.startswith("<![CDATA[", begin):
                end = text.find("]]>", begin)
                at = size if end < 0 else end + 3
            else:
                at = size if begin > last else text.find(">", begin) + 1
            continue
        if not (mark == "/" or ("a" <= mark <= "z") or ("A" <= mark <= "Z")):
            say("<")
            at = begin + 1
            continue
        if begin > last:  # a tag without an end
            break
        m = pattern.match(text, begin)
        if not m:
            if mark != "/" and pattern is _TAG:
                pattern = _LAX
                m = pattern.match(text, begin)
            if not m:  # "</" before something else than a name: no text either
                at = text.find(">", begin) + 1
                continue
        at, tag, ends = m.end(), m[2].lower(), bool(m[1])
        if tag in _RAW:
            if not ends and not m[3].endswith("/"):
                close = _ENDS[tag].search(text, at)
                at = close.end() if close else size
        elif tag in BLOCKS:
            flush()
            link = False
            out.append(("close", tag) if ends else ("open", tag, m[3]))
        elif tag == "br":
            say(" ")
        elif tag == "a":
            link = not ends
        elif tag in CHROME_TAGS:  # buttons and the like, in the middle of text
            flush()
            out.append(("close", tag) if ends else ("open", tag, m[3]))
        elif ends:
            if tag in inline:
                while inline and inline.pop() != tag:
                    pass
                flush()
                out.append(("close", tag))
        elif tag not in VOID and len(m[3]) > 5 and _inline_box(m[3]):
            flush()
            inline.append(tag)
            out.append(("open", tag, m[3]))
    flush()
    return out


def _inline_box(raw: str) -> bool:
    _, hidden, strong, _ = _names(raw)
    return hidden or strong


_SEEN: dict[str, tuple[str, bool, bool, bool]] = {}


def _names(raw: str) -> tuple[str, bool, bool, bool]:
    """(class and id for a signature, hidden or chrome by role, whether it has a strong name, a weak one), remembered within a bound."""
    got = _SEEN.get(raw)
    if got is None:
        if len(_SEEN) > 20_000:
            _SEEN.clear()
        a = {m[1].lower(): (m[2] or m[3] or m[4] or "")[:NAMED] for m in _ATTR.finditer(raw[:4096])}
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", ""))) or a.get("role", "").lower() in _CHROME_ROLES
        names = _CAMEL.sub("-", f"{a.get('class', '')} {a.get('id', '')}").lower().replace("_", "-").strip()
        # numbers in names tell pages apart, not kinds of elements
        sig = re.sub(r"\d+", "0", "." + ".".join(sorted(a.get("class", "").split())) + "#" + a.get("id", "")) if names else ""
        got = sig + ("!" if a.get("role", "").lower() == "main" else ""), hidden, bool(STRONG.search(names)), bool(WEAK.search(names))
        if len(raw) <= 4096:
            _SEEN[raw] = got
    return got


class Node:
    """An element of a page: its signature, children and what its texts come to."""

    __slots__ = ("key", "tag", "hidden", "strong", "weak", "kids", "chars", "links", "title", "repeated")

    def __init__(self, tag: str, raw: str):
        name, self.hidden, self.strong, self.weak = _names(raw) if raw and not raw.isspace() else ("", False, False, False)
        self.key, self.tag = tag + name, tag
        self.kids: list[Node | tuple] = []
        self.chars = self.links = 0
        self.title = tag == "h1"
        self.repeated = False  # whether it stands for several


def tree(stream: list[tuple]) -> Node:
    """The page's elements and texts, with implied ends of elements put in; elements beyond DEPTH are left out, their texts stay."""
    root = Node("#root", "")
    stack = [root]
    paragraphs, deeper = 0, {}  # open ones; by tag, elements open beyond DEPTH

    def pop():
        nonlocal paragraphs
        node = stack.pop()
        paragraphs -= node.tag == "p"
        above = stack[-1]
        above.chars += node.chars
        above.links += node.links
        above.title |= node.title
        if node.tag in _PLAIN and node.key == node.tag:  # what it holds stands for a name
            node.key += ":links" if node.links and node.links >= 0.8 * node.chars else ":blocks" if any(type(k) is Node for k in node.kids) else ":text"

    for token in stream:
        if token[0] == "text":
            stack[-1].kids.append(token)
            stack[-1].chars += len(token[1])
            stack[-1].links += len(token[1]) if token[2] else 0
        elif token[0] == "open":
            tag = token[1]
            if paragraphs and tag in _CLOSES_P:
                while stack[-1].tag != "p":
                    pop()
                pop()
            if tag in _ALIKE and stack[-1].tag in _ALIKE[tag]:
                pop()
            if tag in VOID:
                continue
            if len(stack) > DEPTH:
                deeper[tag] = deeper.get(tag, 0) + 1
                continue
            node = Node(tag, token[2])
            stack[-1].kids.append(node)
            stack.append(node)
            paragraphs += tag == "p"
        elif deeper.get(token[1]):
            deeper[token[1]] -= 1
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == token[1]:
                    while len(stack) > i:
                        pop()
                    break
    while len(stack) > 1:
        pop()
    return root


_at = attrgetter("at")
_first_two = itemgetter(0, 1)


def _place(item: Item | None) -> float:
    return item.at if item is not None else -float("inf")


def _measure(text: tuple) -> tuple[str | None, int, int]:
    """(wording, characters, those in links) of a text of a page; a number of characters stands for unknown wording."""
    said = text[1]
    chars = len(said) if type(said) is str else said
    return said if type(said) is str else None, chars, chars if text[2] else 0


class Level:
    """A part of a wrapper: the items below one element, in order, and the stretches of them that repeat.

    Items are in order by their numbers `at`, groups are pairs of such numbers, so that
    an item put in between moves no other, however many names a host's pages have.
    """

    __slots__ = ("items", "groups", "places", "must", "known")

    def __init__(self, items: list[Item] | None = None, groups: Iterable[Iterable[int]] = ()):
        self.items = items or []
        for i, item in enumerate(self.items):
            item.at = float(i)
        self.groups = [[float(first), float(last)] for first, last in groups]
        self.places: dict[str, list[Item]] = {}
        for item in self.items:
            self.places.setdefault(item.key, []).append(item)
        #: the items that all pages have
        self.must = [item for item in self.items if not item.optional]
        self.known: dict = {}

    def insert(self, item: Item, after: Item | None) -> None:
        i = bisect_right(self.items, after.at, key=_at) if after is not None else 0
        item.at = self._between(i)
        if item.at is None:  # no number is left in between
            new = {x.at: float(k) for k, x in enumerate(self.items)}
            self.groups = [[new[first], new[last]] for first, last in self.groups]
            for x in self.items:
                x.at = new[x.at]
            item.at = self._between(i)
        self.items.insert(i, item)
        insort(self.places.setdefault(item.key, []), item, key=_at)
        if not item.optional:
            insort(self.must, item, key=_at)

    def _between(self, i: int) -> float | None:
        if i == len(self.items):
            return self.items[-1].at + 1 if i else 0.0
        if i == 0:
            return self.items[0].at - 1
        left, right = self.items[i - 1].at, self.items[i].at
        got = (left + right) / 2
        return got if left < got < right else None

    def repeat(self, first: Item, last: Item) -> None:
        """The items first to last become a repeated group, as one with groups they overlap."""
        a, b = first.at, last.at
        for g in [g for g in self.groups if g[0] <= b and a <= g[1]]:
            a, b = min(a, g[0]), max(b, g[1])
            self.groups.remove(g)
        self.groups.append([a, b])

    def _joined(self, low: Item, high: Item) -> bool:
        return any(g[0] <= low.at and high.at <= g[1] for g in self.groups)

    def match(self, keys: list[str]) -> list[Item | None]:
        """The item of each of an element's children; None for those it has no place for.

        The cheapest way through the expression: passing over an item that all pages
        have costs one, staying at one that does not repeat a half, and going back, but
        within a repeated group, one and a half.
        """
        short = tuple(k for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]) if len(keys) > 1 else tuple(keys)
        got = self.known.get(short)
        if got is None:
            got = self._match(short)
            if len(short) <= 64 and len(self.known) < 256:
                self.known[short] = got
        if len(short) == len(keys):
            return got
        out, k = [], -1
        for i, key in enumerate(keys):
            k += i == 0 or key != keys[i - 1]
            out.append(got[k])
        return out

    def _match(self, keys: tuple[str, ...]) -> list[Item | None]:
        def cost(i: Item | None, j: Item) -> float:
            if i is None:
                return bisect_left(self.must, j.at, key=_at)
            if j.at > i.at:
                return bisect_left(self.must, j.at, key=_at) - bisect_right(self.must, i.at, key=_at)
            if j is i:
                return 0.0 if j.repeated else 0.5
            return 0.0 if self._joined(j, i) else 1.5

        alive: dict[Item | None, float] = {None: 0.0}
        back: list[dict[Item, Item | None] | None] = []
        for key in keys:
            spots = self.places.get(key)
            if not spots:
                back.append(None)
                continue
            new, come = {}, {}
            for j in spots:
                if len(spots) == 1 == len(alive):  # only one way, whatever it costs
                    new[j], come[j] = 0.0, next(iter(alive))
                else:
                    new[j], _, come[j] = min(((n + cost(i, j), _place(i), i) for i, n in alive.items()), key=_first_two)
            alive = new
            back.append(come)
        at = min(alive, key=lambda i: (alive[i] + len(self.must) - (bisect_right(self.must, i.at, key=_at) if i is not None else 0), _place(i)))
        out: list[Item | None] = []
        for come in reversed(back):
            if come is None:
                out.append(None)
            else:
                out.append(at)
                at = come[at]
        return out[::-1]

    def add(self, kids: list, first: bool, groups: Iterable[Iterable[float]] = ()) -> None:
        """Align with one element's children, or with the items and groups of another wrapper's level; first: nothing has been seen here before."""
        keys = ["#" if type(k) is tuple else k.key for k in kids]
        spots = self.match(keys) if not first else [None] * len(keys)
        changed = False
        seen: set[Item] = set()
        taken: list[Item] = []
        at: Item | None = None  # the item of the child before
        for key, kid, item in zip(keys, kids, spots):
            if item is None:
                known = self.places.get(key, ())
                if known and (":" not in key or len(known) >= PLACES):
                    item = known[-1]
                else:
                    item = Item(key)
                    item.optional = not first
                    self.insert(item, at)
                    changed = True
            if at is not None and item.at < at.at and not self._joined(item, at):
                self.repeat(item, at)  # the stream goes back to its own beginning
                changed = True
            if not item.repeated and (item is at or (type(kid) is not tuple and kid.repeated)):
                item.repeated = changed = True
            item.see(kid)
            if type(kid) is not Item or not kid.optional:
                seen.add(item)
            taken.append(item)
            at = item
        for a, b in groups:  # of another wrapper: what its items have become
            got = [item for kid, item in zip(kids, taken) if a <= kid.at <= b]
            low, high = min(got, key=_at), max(got, key=_at)
            if low is high:
                low.repeated = True
            elif not self._joined(low, high):
                self.repeat(low, high)
            changed = True
        if any(item not in seen for item in self.must):
            for item in self.must:
                item.optional = item not in seen
            self.must = [item for item in self.must if not item.optional]
            changed = True
        if changed:
            self.known.clear()


class Item:
    """A place in a wrapper: an element with what is below it, or a text, constant or a slot."""

    __slots__ = ("key", "tag", "at", "optional", "repeated", "text", "level", "hidden", "strong", "weak", "chars", "links", "title", "fresh")

    def __init__(self, key: str):
        self.key, self.tag = key, re.split(r"[.#!:]", key)[0] if key[0] != "#" else key
        self.optional = self.repeated = self.hidden = self.strong = self.weak = self.title = False
        self.text: str | None = None
        self.level: Level | None = None
        self.chars = self.links = 0
        self.fresh = True

    def see(self, kid) -> None:
        """Align with a text or an element of a page, or with the item of another wrapper."""
        if self.key == "#":
            said, chars, links = (kid.text, kid.chars, kid.links) if type(kid) is Item else _measure(kid)
            self.text = said if self.fresh or self.text == said else None
            self.chars += chars
            self.links += links
            self.fresh = False
            return
        if self.fresh:
            self.level = Level()
        self.hidden |= kid.hidden
        self.strong |= kid.strong
        self.weak |= kid.weak
        self.title |= kid.title
        self.chars += kid.chars
        self.links += kid.links
        if type(kid) is Item:
            self.level.add(kid.level.items, self.fresh, kid.level.groups)
        else:
            self.level.add(kid.kids, self.fresh)
        self.fresh = False

    def to_list(self) -> list:
        flags = sum(1 << i for i, x in enumerate((self.optional, self.repeated, self.hidden, self.strong, self.weak, self.title)) if x)
        below = 0
        if self.level is not None and self.level.items:
            places = {item.at: i for i, item in enumerate(self.level.items)}
            below = [[i.to_list() for i in self.level.items], [[places[first], places[last]] for first, last in self.level.groups]]
        return [self.key, flags, self.text, below, self.chars, self.links]

    @classmethod
    def of_list(cls, raw: list) -> Item:
        item = cls(raw[0])
        item.optional, item.repeated, item.hidden, item.strong, item.weak, item.title = (bool(raw[1] >> i & 1) for i in range(6))
        item.text, item.chars, item.links, item.fresh = raw[2], raw[4], raw[5], False
        if item.key != "#":
            item.level = Level([cls.of_list(i) for i in raw[3][0]], raw[3][1]) if raw[3] else Level()
        return item

    # roles: what the extraction follows

    def is_content(self) -> bool:
        return self.tag in ("article", "main") or self.key.endswith("!")

    def is_chrome(self, inside: bool) -> bool:
        """Whether all below is chrome; inside: below an article element."""
        if self.hidden or (self.tag in CHROME_TAGS and not (self.tag == "header" and inside)):
            return True
        if self.tag in ("article", "main", "body", "html", "#root"):
            return False
        if self.strong:
            return True
        if inside:
            return False
        listed = self.links >= 0.8 * self.chars > 0 and self.tag in ("ul", "ol", "dl", "div", "section", "table")
        return (self.weak and not self.title) or listed

    def expression(self) -> str:
        """The item as a regular expression over tokens, for people to read."""
        inner = self.level.expression() if self.level else ""
        body = ("#text" if self.text is None else repr(self.text)) if self.key == "#" else f"<{self.key}>{inner}</{self.tag}>"
        return f"({body}){'+' if self.repeated else ''}{'?' if self.optional else ''}" if self.repeated or self.optional else body


def _level_expression(self: Level) -> str:
    out, i = [], 0
    places = {item.at: k for k, item in enumerate(self.items)}
    ends = {places[first]: places[last] for first, last in self.groups}
    while i < len(self.items):
        last = ends.get(i, i)
        part = "".join(item.expression() for item in self.items[i : last + 1])
        out.append(f"({part})+" if last > i else part)
        i = last + 1
    return "".join(out)


Level.expression = _level_expression


class Wrapper:
    """A host's expression."""

    def __init__(self, root: Item | None = None):
        self.root = root or Item("#root")

    def align(self, page: Node | Item) -> None:
        """Make the expression cover this page too, or all that the root of another wrapper covers."""
        self.root.see(page)

    def to_json(self) -> str:
        return json.dumps(self.root.to_list(), ensure_ascii=False, separators=(",", ":"))

    @classmethod
    def of_json(cls, text: str | None) -> Wrapper:
        return cls(Item.of_list(json.loads(text)) if text else None)

    def blocks(self, page: Node):
        """(path, chrome, inside, weak, text, all links, matched) of each text of a page, by the items it is matched to.

        path: a number that names the keys above the text. An element without a place
        below one that has a place is one that no other page has, and is judged by an item
        of its own, as if the wrapper had seen it on this page. Below elements that the
        wrapper knows nothing of, elements take the role of what they stand in, but for
        those that are chrome as elements or hidden; so do texts.
        """
        out = []

        def walk(node: Node, item: Item | None, path: int, chrome: bool, inside: bool, weak: bool):
            keys = ["#" if type(k) is tuple else k.key for k in node.kids]
            known = item is not None and item.level is not None
            spots = item.level.match(keys) if known and keys else [None] * len(keys)
            for kid, key, own in zip(node.kids, keys, spots):
                if type(kid) is tuple:
                    out.append((path, chrome, inside, weak, kid[1], kid[2], own is not None))
                    continue
                if own is None and known:
                    own = Item(key)
                    own.see(kid)
                if own is not None:
                    held = inside or (own.is_content() and not chrome)
                    gone = chrome or own.is_chrome(inside)
                    doubt = weak or (inside and own.weak)
                else:
                    held, doubt = inside, weak
                    gone = chrome or kid.hidden or (kid.tag in CHROME_TAGS and not (kid.tag == "header" and inside))
                walk(kid, own, _path(path, key), gone, held, doubt)

        walk(page, self.root, 0, False, False, False)
        return out


_PATHS: dict[tuple[int, str], int] = {}


def _path(above: int, key: str) -> int:
    got = _PATHS.get((above, key))
    if got is None:
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        got = _PATHS[above, key] = int.from_bytes(blake2b(f"{above}\0{key}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
    return got


def mark(path: int, text: str) -> int:
    """A block's path and wording as a number of 64 bits."""
    return int.from_bytes(blake2b(f"{path}\0{text}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def infer(pages: list[str]) -> str:
    """A host's wrapper as JSON, from all its pages."""
    wrapper = Wrapper()
    for page in dict.fromkeys(pages):
        root = tree(tokens(page))
        if root.chars:
            wrapper.align(root)
    return "" if wrapper.root.fresh else wrapper.to_json()


def skeleton(node: Node) -> list:
    """A page's elements as [key, flags, children], its texts as numbers of characters, below zero where all are links.

    Like elements in a row that the wrapper has one place for count as one that repeats, with the characters of all.
    """
    out = [node.key, node.hidden | node.strong << 1 | node.weak << 2 | (node.tag == "h1") << 3]
    for kid in node.kids:
        if type(kid) is tuple:
            out.append(-len(kid[1]) if kid[2] else len(kid[1]))
        else:
            bones = skeleton(kid)
            if type(out[-1]) is list and ":" not in bones[0] and _alike(out[-1], bones):
                _join(out[-1], bones)
                out[-1][1] |= 16
            else:
                out.append(bones)
    return out


def _alike(a: list, b: list) -> bool:
    if len(a) != len(b) or a[0] != b[0] or (a[1] ^ b[1]) & 15:
        return False
    for x, y in zip(a[2:], b[2:]):
        if type(x) is not type(y) or not (_alike(x, y) if type(x) is list else (x < 0) == (y < 0)):
            return False
    return True


def _join(a: list, b: list) -> None:
    a[1] |= b[1]
    for i in range(2, len(a)):
        if type(a[i]) is list:
            _join(a[i], b[i])
        else:
            a[i] += b[i]


def fleshed(bones: list, alone: frozenset[int]) -> Node:
    """The elements of a skeleton without those whose key is in alone; their characters still count for what they stand in."""
    node = Node(bones[0], "")
    node.hidden, node.strong, node.weak, node.title, node.repeated = (bool(bones[1] >> i & 1) for i in range(5))
    for kid in bones[2:]:
        if type(kid) is int:
            node.kids.append(("text", abs(kid), kid < 0))
            node.chars += abs(kid)
            node.links += abs(kid) if kid < 0 else 0
        else:
            below = fleshed(kid, alone)
            node.chars += below.chars
            node.links += below.links
            node.title |= below.title
            if not alone or _path(0, kid[0]) not in alone:
                node.kids.append(below)
    return node


def evidence(html: str | None) -> tuple[list[int], list[int], bytes]:
    """(marks of blocks that a template may hold, hashes of the keys of elements with a name, each once, and the page's skeleton).

    Marks are of blocks outside article and main, and of those below weak names.
    """
    found: set[int] = set()
    named: set[int] = set()

    def walk(node: Node, path: int, inside: bool, weak: bool):
        for kid in node.kids:
            if type(kid) is tuple:
                if not inside or weak:
                    found.add(mark(path, kid[1]))
            else:
                if len(kid.key) > len(kid.tag) and kid.key[len(kid.tag)] != ":":
                    named.add(_path(0, kid.key))
                walk(kid, _path(path, kid.key), inside or kid.tag in ("article", "main") or kid.key.endswith("!"), weak or kid.weak)

    page = tree(tokens(html))
    walk(page, 0, False, False)
    return sorted(found), sorted(named), zlib.compress(json.dumps(skeleton(page), ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 1)


def extract(html: str | None, wrapper: Wrapper, template: Iterable[int]) -> list[str]:
    """The blocks of a page that are its article, in page order: those at the wrapper's article items.

    Where the page has text in an article element, that text; else all that is no
    chrome. Template wording goes outside article elements, and below weak names inside
    them, as do links there.
    """
    found = wrapper.blocks(tree(tokens(html)))
    held = any(inside and not chrome for _, chrome, inside, *_ in found)
    out = []
    for path, chrome, inside, weak, text, links, _ in found:
        if chrome or (held and not inside):
            continue
        if inside and not weak:
            out.append(text)
        elif not (inside and links) and not (template and mark(path, text) in template):
            out.append(text)
    return out


def host(url) -> F.Column:
    """The host part of a URL column, lowered; an empty string where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _rows(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    rows = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    return rows.filter(F.col("html").isNotNull()).withColumn("page", F.xxhash64("html"))


def evidences(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, page, marks, named, skeleton): one row for each different page of a host."""

    def run(batches):
        for part in slices(batches, "html"):
            found = [evidence(html) for html in part.column(2).to_pylist()]
            kinds = pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
            arrays = [part.column(0), part.column(1), *(pa.array([f[i] for f in found], type=kind) for i, kind in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "page", "marks", "named", "skeleton"])

    read = _rows(pages, url_col, html_col).select("host", "page", "html").mapInArrow(run, "host string, page long, marks array<long>, named array<long>, skeleton binary")
    return read.dropDuplicates(["host", "page"])


def _aligned(rows: DataFrame, take: Callable[[Wrapper, dict], None]) -> DataFrame:
    """(host, part, wrapper): a wrapper for each host and part, which take() has aligned with its rows in the order of their column `at`.

    Rows pass by in order, so a task holds one wrapper and no host's pages.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, wrapper = None, Wrapper()

        def ready() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], type=t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["host", "part", "wrapper"])
            done.clear()
            return out

        size = 0
        for batch in batches:
            for row in (row for i in range(0, batch.num_rows, 64) for row in batch.slice(i, 64).to_pylist()):
                if (row["host"], row["part"]) != now:
                    if now is not None:
                        done.append((*now, "" if wrapper.root.fresh else wrapper.to_json()))
                        size += len(done[-1][2]) + 64
                    now, wrapper = (row["host"], row["part"]), Wrapper()
                    if size >= SLICE_CHARS:
                        yield ready()
                        size = 0
                take(wrapper, row)
        if now is not None:
            done.append((*now, "" if wrapper.root.fresh else wrapper.to_json()))
            yield ready()

    return rows.repartition("host", "part").sortWithinPartitions("host", "part", "at").mapInArrow(run, "host string, part int, wrapper string")


def wrappers(different: DataFrame, totals: DataFrame) -> DataFrame:
    """(host, wrapper): inferred from all different pages of each host; totals (host, n_pages) says how many they are.

    Elements whose named key only one page of the host has can be aligned with nothing.
    They are left out, and judged by themselves when that page is read, so a wrapper
    grows with what pages share, not with the names that each page makes up. Hosts of more
    than PART pages are dealt over tasks by hash, and their wrappers merged in rounds.
    """
    once = different.select("host", "page", F.explode("named").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"), F.min("page").alias("page"))
    once = once.filter(F.col("n") == 1).groupBy("host", "page").agg(F.collect_list("key").alias("alone"))
    parts = totals.filter(F.col("n_pages") > PART).select("host", F.ceil(F.col("n_pages") / PART).cast("int").alias("parts"))
    n_hosts, most = parts.agg(F.count("*"), F.coalesce(F.max("parts"), F.lit(1))).first()
    parts = F.broadcast(parts) if n_hosts <= 100_000 else parts
    rows = different.select("host", "page", "skeleton").join(once, ["host", "page"], "left").join(parts, "host", "left")
    rows = rows.select("host", F.coalesce(F.pmod(F.xxhash64("page"), F.col("parts")), F.lit(0)).cast("int").alias("part"), F.col("page").alias("at"), "skeleton", "alone")

    def learn(wrapper: Wrapper, row: dict) -> None:
        root = fleshed(json.loads(zlib.decompress(row["skeleton"]).decode("utf-8", "surrogatepass")), frozenset(row["alone"] or ()))
        if root.chars:
            wrapper.align(root)

    def merge(wrapper: Wrapper, row: dict) -> None:
        if row["wrapper"]:
            wrapper.align(Wrapper.of_json(row["wrapper"]).root)

    got = _aligned(rows, learn)
    while most > 1:
        got = _aligned(got.select("host", F.floor(F.col("part") / FAN).cast("int").alias("part"), F.col("part").alias("at"), "wrapper"), merge)
        most = -(-most // FAN)
    return got.select("host", "wrapper")


def totals(different: DataFrame) -> DataFrame:
    """(host, n_pages): how many different pages a host has."""
    return different.groupBy("host").agg(F.count("*").alias("n_pages"))


def templates(different: DataFrame, total: DataFrame) -> DataFrame:
    """(host, n_pages, template): how many different pages a host has, and the marks that they share.

    Every different page counts once, with all its blocks. Inside the article only
    wording below weak names can be template, as copies and series of articles may
    share the rest.
    """
    counted = different.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    shared = counted.join(total, "host").filter(F.col("n") >= SHARE * F.col("n_pages"))
    return total.join(shared.groupBy("host").agg(F.sort_array(F.collect_list("mark")).alias("template")), "host", "left")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): one row a page, its article's blocks joined by a blank line.

    Null and empty pages, and pages without an article text, give an empty string; null
    urls share the host ''. Repeated rows get equal results, empty input none; other
    columns are ignored. Pages are read whole, however long or deep, and every different
    page of a host takes part in its wrapper and template.
    """
    different = durable(evidences(pages, url_col, html_col))
    total = durable(totals(different))
    learned = templates(different, total).join(wrappers(different, total), "host", "left")
    learned = durable(learned.select("host", "n_pages", "wrapper", F.coalesce("template", F.array().cast("array<long>")).alias("template")))
    size = learned.agg(F.coalesce(F.sum(F.length(F.coalesce("wrapper", F.lit(""))) + F.length("host") + 8 * F.size("template")), F.lit(0))).first()[0]
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("__html"), host(F.col(url_col)).alias("host"))
    schema = "id {}, url {}, text string, n_chars long".format(*(pages.schema[c].dataType.simpleString() for c in (id_col, url_col)))

    def texts(part: pa.RecordBatch, found: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, type=pa.string()), pa.array([len(t) for t in found], type=pa.int64())], names=["id", "url", "text", "n_chars"])

    if size <= BROADCAST:
        known = pages.sparkSession.sparkContext.broadcast({r["host"]: (r["wrapper"], r["template"]) for r in learned.select("host", "wrapper", "template").collect()})

        def run(batches):
            parsed: dict[str, tuple] = {}
            for part in slices(batches, "__html"):
                found = []
                for html, name in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if name not in parsed:
                        if len(parsed) > 512:
                            parsed.clear()
                        wrapper, template = known.value.get(name, (None, ()))
                        parsed[name] = Wrapper.of_json(wrapper), frozenset(template)
                    found.append("\n\n".join(extract(html, *parsed[name])))
                yield texts(part, found)

        out = rows.mapInArrow(run, schema)
    else:  # a host's wrapper comes once before its pages; hosts of very many pages are dealt over parts, each with a copy of it
        parts = F.ceil(F.col("n_pages") / HOT).cast("int")
        hot = learned.filter(F.col("n_pages") > HOT).select("host", parts.alias("parts"))  # a HOT-th of all pages at most
        hot = F.broadcast(hot) if hot.count() <= 100_000 else hot
        part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("__html"), F.col("parts"))).otherwise(0).cast("int").alias("part")
        rows = rows.join(hot, "host", "left").select("__id", "__url", "__html", "host", part, F.lit(1).alias("kind"))
        first = learned.select("host", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("part"), F.lit(0).alias("kind"), F.col("wrapper").alias("__html"), "template")
        met = rows.unionByName(first, allowMissingColumns=True).repartition("host", "part").sortWithinPartitions("host", "part", "kind")

        def run(batches):
            now, current = None, (Wrapper(), frozenset())
            for batch in slices(batches, "__html"):
                found = []
                kinds = batch.column(5).to_pylist()
                for i, (html, *at, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), kinds)):
                    if kind == 0:
                        now, current = at, (Wrapper.of_json(html), frozenset(batch.column(6)[i].as_py()))
                        continue
                    if at != now:  # a host of null pages only
                        now, current = at, (Wrapper(), frozenset())
                    found.append("\n\n".join(extract(html, *current)))
                yield texts(batch.filter(pa.array([k == 1 for k in kinds], type=pa.bool_())), found)

        out = met.mapInArrow(run, schema)
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
