"""Main-text extraction by wrappers: union-free regular expressions inferred from the pages of a host.

1. A page becomes a stream of block tags and text slots. Runs of one structure (li, li, li; p, p)
   fold into repeated groups, innermost first.
2. The pages of a host are aligned one after the other with the wrapper so far. Where they differ,
   a group that is there several times on one side becomes a repeated group, what only one side has
   an optional group, and differing texts leave a slot. Pages of one structure are aligned once. The
   wrapper covers each of them.
3. Tasks first fold the pages they read into one wrapper a host; only these partial wrappers are
   shuffled and aligned again, first in a few parts a host, so that a host with a third of all pages
   is no hot group.
   A wrapper that grows beyond its pages (blocks in any order) becomes one repeated group of optional
   tokens, a token each; from there on it grows with the kinds of blocks, not with the pages.
4. Each slot of the wrapper carries what the pages had there: one text (or, in a repeated group, one
   run of texts) or differing ones. By that and by the tags and classes around it the slot is content
   or boilerplate: inside an article too, a text that all pages share is the template's, a repeated
   group of nothing but links is a list of links, and forms and what a class word sets apart are out.
5. Pages are read again and matched against their wrapper, which gives the slot of each text; the
   texts in content slots come out.

Wrappers are joined to the pages by host; Spark broadcasts them if they are small, else it splits hot hosts.

Defined cases: a null html counts as empty and gives an empty text; a null or odd url is a host of
its own. Rows are read one by one, also where they repeat. Unclosed tags, scripts and comments end
with the page. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stage

# HTML's elements by how they nest, and the names by which pages mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = "script style noscript template textarea select svg iframe object video audio canvas button head title"
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary menu dialog hr center".split()
)
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
OUTSIDE_TAGS = frozenset("nav footer aside menu dialog".split())
LAYOUT_WORDS = frozenset("with has have no without layout".split())  # with-sidebar: not the sidebar
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt th caption summary".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe subscription signup login register comment comments reply replies respond disqus share sharing social related recommended recommendations widget pagination pager copyright skip".split()
)
INSIDE_TAGS = frozenset(("article", "main"))
# Class words that name parts of an article, not of the page, where they stand within one.
ARTICLE_WORDS = frozenset("header masthead banner side notice notices".split())

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[>\"']")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW.split()}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_LONGEST_SQUARE = 16
#: Elements nested deeper than this add to the path of a text only if none of their kind has, so that paths are bounded.
DEEP = 200
#: So many different pages with one text in a slot make it a fixed one.
LEAST_PAGES = 3
#: Tokens that a wrapper may have, or twice those of its longest page, before it becomes a group of optional tokens; and tokens of such a group.
MOST_TOKENS, MOST_KINDS = 400, 4000


def _marks(attributes: str) -> tuple[str, str]:
    """An element's class and id words, and a mark if its role or style (!) or else such a word (~, or ^ for a word that an article's parts may have) sets it apart."""
    words, apart, named, harsh = [], False, False, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            own = re.findall(r"[a-z]+", re.sub(r"\d+", "", value))
            words += own
            if not OUTSIDE_WORDS.isdisjoint(own):
                for w in (re.findall(r"[a-z]+", t) for t in value.split()):
                    if not OUTSIDE_WORDS.isdisjoint(w) and LAYOUT_WORDS.isdisjoint(w):
                        named, harsh = True, harsh or not (OUTSIDE_WORDS - ARTICLE_WORDS).isdisjoint(w)
        elif name == "role":
            apart |= value in OUTSIDE_ROLES
        elif name == "style":
            apart |= "display:none" in value.replace(" ", "")
        else:
            apart |= value != "false"
    return ".".join(sorted(set(words))), "!" if apart else "~" if harsh else "^" if named else ""


def tags(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, slash, name, attributes) of each text and tag, in one pass; raw elements and comments are left out.

    A value in quotes may hold ``>``. From the first tag on that the page's end leaves open within
    quotes, a tag ends with the next ``>``. After the last ``>`` all is text.
    """
    at, size, last, quotes = 0, len(page), page.rfind(">"), True
    while at < size:
        start = page.find("<", at)
        if start < 0 or (start > last and not page.startswith("<!--", start)):
            yield page[at:], "", "", ""
            return
        if start > at:
            yield page[at:start], "", "", ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if page[start + 1] in "!?":
            at = page.find(">", start) + 1
            continue
        found = _NAME.match(page, start + 1)
        if not found:
            yield "<", "", "", ""
            at = start + 1
            continue
        end = _tag_end(page, found.end()) if quotes else -1
        if end < 0:
            quotes, end = False, page.find(">", found.end())
        slash, name, attributes, at = found[1], found[2].lower(), page[found.end() : end], end + 1
        if not slash and name in _RAW_END:
            if name != "svg" or not attributes.endswith("/"):
                close = _RAW_END[name].search(page, at)
                at = close.end() if close else size
            continue
        yield "", slash, name, attributes


def _tag_end(page: str, at: int) -> int:
    """Where a tag's ``>`` outside of quotes stands, or -1."""
    while found := _STOP.search(page, at):
        if found[0] == ">":
            return found.start()
        close = page.find(found[0], found.end())
        if close < 0:
            return -1
        at = close + 1
    return -1


def blocks(page: str) -> tuple[list[str], list[tuple[str, str]]]:
    """The stream of block tags and slots, and the (path, text) of each block of text.

    A path is the elements around a text, ``!``, ``~`` or ``^`` marking one that is set apart; ``/@`` ends
    the path of a text that is all links. A slot is ``#`` and its path.
    """
    stack: list[tuple[str, str, str, frozenset]] = []  # (tag, label, path, kinds that deep elements have added)
    blocks_at: list[int] = []  # where in the stack blocks stand
    opened: Counter = Counter()
    stream: list[str] = []
    found: list[tuple[str, str]] = []
    pending: list[str] = []
    links = [True]  # whether all of the pending text is within links

    def flush() -> None:
        if pending:
            text = " ".join(entities.unescape("".join(pending)).split())
            pending.clear()
            linked, links[0] = links[0], True
            if text:
                at = (stack[-1][2] if stack else "") + "/@" * linked
                stream.append(f"#{at}")
                found.append((at, text))

    def close(at: int) -> None:
        for tag, label, _, _ in reversed(stack[at:]):
            opened[tag] -= 1
            if tag in BLOCK:
                stream.append(f"</{label}>")
                blocks_at.pop()
        del stack[at:]

    def push(tag: str, label: str, shown: bool) -> None:
        path, kinds = stack[-1][2:] if stack else ("", frozenset())
        if shown and len(stack) >= DEEP:
            kind = tag + label[-1] * (label[-1] in "!~^")
            shown, kinds, label = kind not in kinds, kinds | {kind}, kind
        if shown:
            path = f"{path}/{label}" if path else label
        stack.append((tag, label, path, kinds))
        opened[tag] += 1

    for text, slash, tag, attributes in tags(page):
        if text:
            pending.append(text)
            links[0] &= opened["a"] > 0 or text.isspace()
            continue
        block = tag in BLOCK
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                pending.append(" ")
            continue
        if slash:
            if not opened[tag]:
                continue
            at = len(stack) - 1
            while stack[at][0] != tag:
                at -= 1
            if block or any(x[0] in BLOCK or x[1][-1] in "!~^" for x in stack[at:]):
                flush()
            close(at)
            continue
        words, apart = _marks(attributes) if attributes else ("", "")
        if block or apart:
            flush()
        if block:
            ends = CLOSED_BY_SAME.get(tag, ()) + tuple(CLOSED_BY_BLOCK)
            if blocks_at and stack[blocks_at[-1]][0] in ends:
                close(blocks_at[-1])
                if blocks_at and tag in CLOSED_BY_SAME and stack[blocks_at[-1]][0] in CLOSED_BY_SAME[tag]:
                    close(blocks_at[-1])
            blocks_at.append(len(stack))
        push(tag, tag + (f".{words}" if words and block else "") + apart, block or bool(apart))
        if block:
            stream.append(f"<{stack[-1][1]}>")
    flush()
    close(0)
    return stream, found


# A wrapper is a tuple of nodes: a tag (str), a slot, or (sign, nodes): "+" once or more, "?" at most once, "*" any number.


class Slot(str):
    """A place for text, equal to others of its path, and what pages have there.

    ``text`` is a hash of the one text or run of texts that all pages have, or None where they
    differ; ``seen`` holds the least hashes of different pages, as many as make evidence.
    """

    __slots__ = ("seen", "text")

    def __new__(cls, path: str, text: int | None, seen: tuple) -> Slot:
        self = super().__new__(cls, path)
        self.text, self.seen = text, seen
        return self

    def fixed(self) -> bool:
        return self.text is not None and len(self.seen) >= LEAST_PAGES


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _both(a: Slot, b: Slot, run: bool) -> Slot:
    """One slot of two: of one page's run of texts, or of different pages."""
    if run:
        text = None if a.text is None or b.text is None else _hash(f"{a.text} {b.text}")
    else:
        text = a.text if a.text == b.text else None
    return Slot(a, text, a.seen if a.seen == b.seen else tuple(sorted({*a.seen, *b.seen})[:LEAST_PAGES]))


def merged(a: tuple | list, b: tuple | list, run: bool = False) -> tuple:
    """Equal nodes, with what the slots of both have seen."""
    return tuple((x[0], merged(x[1], y[1], run)) if isinstance(x, tuple) else _both(x, y, run) if isinstance(x, Slot) else x for x, y in zip(a, b, strict=True))


def slots(nodes: tuple) -> Iterator[Slot]:
    for n in nodes:
        if isinstance(n, tuple):
            yield from slots(n[1])
        elif isinstance(n, Slot):
            yield n


def folded(stream: list) -> tuple:
    """Neighbouring equal runs of nodes become one repeated group."""
    out: list = []
    for node in stream:
        out.append(node)
        again = True
        while again:
            again = False
            for width in range(1, min(_LONGEST_SQUARE, len(out) - 1) + 1):
                tail = out[-width:]
                before = out[-width - 1]
                if isinstance(before, tuple) and before[0] in "+*" and list(before[1]) == tail:
                    out[-width - 1 :] = [(before[0], merged(before[1], tail, True))]
                    again = True
                    break
                if before == tail[-1] and len(out) >= 2 * width and out[-2 * width : -width] == tail and balanced(tail):
                    out[-2 * width :] = [("+", merged(out[-2 * width : -width], tail, True))]
                    again = True
                    break
    return tuple(out)


def balanced(nodes: list) -> bool:
    """Whether tags open and close within, so that a group is a piece of structure."""
    depth = 0
    for n in nodes:
        if isinstance(n, str) and not isinstance(n, Slot):
            depth += -1 if n.startswith("</") else 1
            if depth < 0:
                return False
    return depth == 0


def aligned(a: tuple, b: tuple) -> tuple:
    """The union-free expression that covers both."""
    if a == b:
        return merged(a, b)
    out: list = []
    for op, a0, a1, b0, b1 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        left, right = a[a0:a1], b[b0:b1]
        if op == "equal":
            out += merged(left, right)
        else:
            out += resolved(left, right)
    return folded(out)


def tokens(nodes: tuple) -> int:
    return sum(tokens(n[1]) if isinstance(n, tuple) else 1 for n in nodes)


def loose(nodes: tuple) -> bool:
    """Whether a wrapper is one repeated group of optional tokens."""
    return len(nodes) == 1 and isinstance(nodes[0], tuple) and nodes[0][0] == "*" and all(isinstance(n, tuple) and n[0] == "?" and len(n[1]) == 1 and isinstance(n[1][0], str) for n in nodes[0][1])


def loosened(*wrappers: tuple) -> tuple:
    """One repeated group of all tokens, each optional: any page of these tokens is of it. A slot has one text if all of its path have."""
    kinds: dict[str, str] = {}

    def collect(nodes: tuple) -> None:
        for n in nodes:
            if isinstance(n, tuple):
                collect(n[1])
            elif n not in kinds:
                if len(kinds) < MOST_KINDS:  # pages of other tokens are judged alone
                    kinds[n] = n
            elif isinstance(n, Slot):
                kinds[n] = _both(kinds[n], n, False)

    for w in wrappers:
        collect(w)
    return (("*", tuple(("?", (kinds[k],)) for k in sorted(kinds))),)


def covering(a: tuple, b: tuple, longest: int) -> tuple:
    """``aligned``, bounded by the longest page of both."""
    if a != b and (loose(a) or loose(b)):
        return loosened(a, b)
    both = aligned(a, b)
    return loosened(both) if tokens(both) > max(MOST_TOKENS, 2 * longest) else both


def resolved(left: tuple, right: tuple) -> list:
    """A mismatch: repeated and optional groups take in what they match; all else becomes optional."""
    if len(left) == len(right) == 1 and isinstance(left[0], tuple) and isinstance(right[0], tuple):
        (s, x), (t, y) = left[0], right[0]
        return [(_sign(s, t), aligned(x, y))]
    for one, other in ((left, right), (right, left)):
        if len(one) == 1 and isinstance(one[0], tuple) and other:
            sign, inner = one[0]
            if other == inner or difflib.SequenceMatcher(None, inner, other, autojunk=False).ratio() > 0.6:
                return [(sign, aligned(inner, other))]
    return _optional(left) + _optional(right)


def _sign(s: str, t: str) -> str:
    """What allows for both: many if one does, none if one does."""
    many, none = {s, t} & {"+", "*"}, {s, t} & {"?", "*"}
    return "*" if many and none else "+" if many else "?"


def _optional(nodes: tuple) -> list:
    if not nodes:
        return []
    if len(nodes) == 1 and isinstance(nodes[0], tuple):
        return [(_sign("?", nodes[0][0]), nodes[0][1])]
    return [("?", nodes)]


def shown(wrapper: tuple) -> str:
    """The wrapper as a regular expression over tags and slots."""
    return " ".join(f"({shown(n[1])}){n[0]}" if isinstance(n, tuple) else "#" if isinstance(n, Slot) else n for n in wrapper)


class Matcher:
    """A wrapper as a machine that reads a page's stream and tells the slot of each text."""

    def __init__(self, wrapper: tuple) -> None:
        #: (token, number of the slot or None), or (None, the two places to go on at)
        self.steps: list[tuple] = []
        self.n_slots = 0
        self._compile(wrapper)

    def _compile(self, nodes: tuple) -> None:
        for n in nodes:
            if not isinstance(n, tuple):
                self.steps.append((str(n), self.n_slots if isinstance(n, Slot) else None))
                self.n_slots += isinstance(n, Slot)
                continue
            start = len(self.steps)
            if n[0] in "?*":
                self.steps.append((None, None))
            body = len(self.steps)
            self._compile(n[1])
            if n[0] in "+*":
                self.steps.append((None, (body, len(self.steps) + 1)))
            if n[0] in "?*":
                self.steps[start] = (None, (body, len(self.steps)))

    def _reached(self, at: int, path: tuple | None, into: dict[int, tuple | None]) -> None:
        todo = [at]
        while todo:
            at = todo.pop()
            if at in into:
                continue
            into[at] = path
            if at < len(self.steps) and self.steps[at][0] is None:
                first, second = self.steps[at][1]
                todo += (second, first)

    def slots_of(self, stream: list[str]) -> list[int] | None:
        """The slot of each text, or None if the page isn't of this structure. Groups take what they can."""
        states: dict[int, tuple | None] = {}
        self._reached(0, None, states)
        for token in stream:
            following: dict[int, tuple | None] = {}
            for at, path in states.items():
                if at < len(self.steps) and self.steps[at][0] == token:
                    slot = self.steps[at][1]
                    self._reached(at + 1, path if slot is None else (slot, path), following)
            if not following:
                return None
            states = following
        if len(self.steps) not in states:
            return None
        path, out = states[len(self.steps)], []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return out[::-1]


def shape(stream: list[str], texts: list[str]) -> tuple:
    """A page folded, its slots holding its texts."""
    page, following = (_hash("\n".join(texts)),), iter(texts)
    return folded([Slot(t, _hash(next(following)), page) if t[0] == "#" else t for t in stream])


class Host:
    """The wrapper of a host's pages; pages of one shape are held together until they are aligned."""

    def __init__(self, wrapper: tuple = (), pages: int = 0, longest: int = 0) -> None:
        self._wrapper, self.pages, self.longest, self._fresh = wrapper, pages, longest, pages == 0
        self.shapes: dict[tuple, tuple] = {}

    def add(self, page: str) -> int:
        """How much there is more to hold."""
        stream, found = blocks(page)
        return self.take(shape(stream, [t for _, t in found]))

    def take(self, one: tuple) -> int:
        held = self.shapes.get(one)
        self.shapes[one] = one if held is None else merged(held, one)
        self.pages += 1
        self.longest = max(self.longest, tokens(one))
        return len(one) if held is None else 0

    @property
    def wrapper(self) -> tuple:
        for one in self.shapes.values():
            self._wrapper = one if self._fresh else covering(self._wrapper, one, self.longest)
            self._fresh = False
        self.shapes = {}
        return self._wrapper

    def join(self, other: Host) -> None:
        mine, self.longest = self.wrapper, max(self.longest, other.longest)
        self._wrapper = other.wrapper if self._fresh else covering(mine, other.wrapper, self.longest)
        self._fresh = False
        self.pages += other.pages

    def dump(self) -> str:
        return json.dumps([_plain(self.wrapper), self.pages, self.longest])

    @staticmethod
    def load(text: str) -> Host:
        wrapper, pages, longest = json.loads(text)
        return Host(_again(wrapper), pages, longest)

    def content(self) -> list[str]:
        """The paths of content slots."""
        return sorted({str(s)[1:] for s, fit in zip(slots(self.wrapper), roles(self.wrapper), strict=True) if fit})


def _plain(nodes: tuple) -> list:
    return [[n[0], _plain(n[1])] if isinstance(n, tuple) else [str(n), n.text, n.seen] if isinstance(n, Slot) else n for n in nodes]


def _again(nodes: list) -> tuple:
    return tuple(n if isinstance(n, str) else (n[0], _again(n[1])) if len(n) == 2 else Slot(n[0], n[1], tuple(n[2])) for n in nodes)


# How a text stands, in rising order of what makes it content.
OUT, NAMED, PLAIN, ODD_ARTICLE, ARTICLE = range(5)


def standing(path: str) -> tuple[int, bool]:
    """How a text stands by the elements around it, and whether a part of its article sets it apart: a form, or a class word.

    Tags and roles that set a text apart outweigh all. Class words only count where no article or
    main element is around them or within: such words also name layouts. An article's own header
    is part of it, and an article whose own class sets it apart (a comment) is one if there is no other.
    """
    level, within = PLAIN, False
    for label in path.split("/"):
        tag, mark = label.rstrip("!~^").split(".")[0], label[-1:] if label[-1:] in "!~^" else ""
        if mark == "!" and tag not in ("html", "body"):
            return OUT, False
        if tag in INSIDE_TAGS:
            if level < ODD_ARTICLE or (level == ODD_ARTICLE and tag == "main"):
                level = ODD_ARTICLE if mark and tag != "main" else ARTICLE
                within = False
            elif mark == "~":
                within = True
        elif tag in OUTSIDE_TAGS or (tag == "header" and level < ODD_ARTICLE):
            return OUT, False
        elif mark or tag in ("form", "fieldset"):
            if level == PLAIN and tag not in ("html", "body"):
                level = NAMED
            elif level >= ODD_ARTICLE and mark != "^":
                within = True
    return level, within


def kind_of(paths: Iterable[str]) -> int:
    """The structure of a page by its texts: how the best of them stands."""
    return max((standing(p)[0] for p in paths), default=OUT)


def grouped(nodes: tuple, repeated: bool = False) -> Iterator[bool]:
    """For each slot, whether it is in a repeated group that has nothing but links."""
    for n in nodes:
        if isinstance(n, tuple):
            yield from grouped(n[1], repeated or (n[0] in "+*" and all(x.endswith("/@") for x in slots(n[1]))))
        elif isinstance(n, Slot):
            yield repeated


def roles(wrapper: tuple) -> list[bool]:
    """For each slot of the wrapper, whether it is content.

    A slot is where its text stands as the page's best, and no part of its article that is set apart.
    Of these, a repeated group of links is none, and one whose text is the same on different pages is
    the template's, but for a heading of texts that differ. In articles the latter only holds if more
    of their slots differ: pages that are all but copies tell nothing. Copies of a page are no evidence.
    """
    found = list(slots(wrapper))
    stands = [standing(s[1:].removesuffix("/@")) for s in found]
    kind = max((level for level, _ in stands), default=OUT)
    best = [level == kind and level > OUT and not (within and level >= ODD_ARTICLE) for level, within in stands]
    listed = [False] * len(found) if loose(wrapper) else list(grouped(wrapper))
    best = [fit and not link for fit, link in zip(best, listed, strict=True)]
    n_fixed = sum(fit and slot.fixed() for fit, slot in zip(best, found, strict=True))
    telling = kind < ODD_ARTICLE or 2 * n_fixed < sum(best)
    out = []
    for i, (slot, fit) in enumerate(zip(found, best, strict=True)):
        if fit and slot.fixed() and telling:
            heads, _, tag = slot[1:].removesuffix("/@").rpartition("/")
            after = found[i + 1] if i + 1 < len(found) else None
            fit = tag.split(".")[0].rstrip("!~^") in HEADINGS and after is not None and best[i + 1] and not after.fixed() and f"{after[1:]}/".startswith(f"{heads}/")
        out.append(fit)
    return out


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, html) -> partial wrappers, one for each structure of a host's pages."""
    hosts: dict[tuple[str, int], Host] = {}
    held = 0
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            stream, found = blocks(page or "")
            key = host, kind_of(p for p, _ in found)
            held += hosts.setdefault(key, Host()).take(shape(stream, [t for _, t in found]))
        if held > 500_000:
            yield _dumped(hosts)
            hosts, held = {}, 0
    if hosts:
        yield _dumped(hosts)


def _dumped(hosts: dict[tuple[str, int], Host]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h for h, _ in hosts]), pa.array([k for _, k in hosts], pa.int32()), pa.array([h.dump() for h in hosts.values()])], names=["host", "kind", "state"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, kind, state) sorted by host and kind -> one row for each of them."""
    at, state = None, None
    for batch in batches:
        for host, kind, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (host, kind) != at:
                if state is not None:
                    yield _dumped({at: state})
                at, state = (host, kind), Host.load(text)
            else:
                state.join(Host.load(text))
    if state is not None:
        yield _dumped({at: state})


def _roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        states = [Host.load(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.pages for s in states], pa.int64()), pa.array([shown(s.wrapper) for s in states]), pa.array([json.dumps([_plain(s.wrapper), roles(s.wrapper)]) for s in states])], names=["host", "kind", "pages", "wrapper", "rules"])


class Rules:
    """The matchers and roles of one host, by the structure of pages."""

    def __init__(self, texts: list[dict]) -> None:
        self.by_kind = {}
        for r in texts:
            wrapper, fit = json.loads(r["rules"])
            self.by_kind[r["kind"]] = (Matcher(_again(wrapper)), fit)
        self.known: dict[tuple, list[bool]] = {}

    def of(self, stream: list[str], found: list[tuple[str, str]]) -> list[bool]:
        """For each text whether it comes out. A page that no wrapper matches is judged by its own shape."""
        key = tuple(stream)
        fits = self.known.get(key)
        if fits is None:
            matcher, fit = self.by_kind.get(kind_of(p for p, _ in found), (None, None))
            at = matcher.slots_of(stream) if matcher else None
            if at is None:
                one = shape(stream, [t for _, t in found])
                at, fit = Matcher(one).slots_of(stream), roles(one)
            fits = [fit[i] for i in at]
            if len(self.known) < 1000:
                self.known[key] = fits
        return fits


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, Rules] = {}
    for batch in batches:
        texts = []
        hosts = batch.column(3)
        rules = batch.column(4)
        for i, (page, host) in enumerate(zip(batch.column(2).to_pylist(), hosts.to_pylist(), strict=True)):
            if host not in known:
                if len(known) >= 1000:
                    known.clear()
                known[host] = Rules(rules[i].as_py() or [])
            stream, found = blocks(page or "")
            texts.append("\n".join(t for (_, t), fit in zip(found, known[host].of(stream, found), strict=True) if fit))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def wrappers(pages: DataFrame, parts: int = 8) -> DataFrame:
    """``host, kind, pages, wrapper, rules`` from (host, html): the wrapper of each structure and which of its slots are content."""
    state = "host string, kind int, state string"
    partial = pages.mapInArrow(_fold, state).withColumn("part", F.pmod(F.xxhash64("state"), F.lit(parts)))
    some = partial.repartition("host", "kind", "part").sortWithinPartitions("host", "kind", "part").select("host", "kind", "state").mapInArrow(_merge, state)
    whole = some.repartition("host", "kind").sortWithinPartitions("host", "kind", "state").mapInArrow(_merge, state)
    return whole.mapInArrow(_roles, "host string, kind int, pages long, wrapper string, rules string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each page: ``page_id, url, text, n_chars``."""
    bound_batches(pages.sparkSession)
    named = F.lower(F.regexp_extract(F.col(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), F.when(named != "", named).alias("host"))
    found = stage(wrappers(rows.where("host IS NOT NULL").select("host", "html")), "wrappers")
    found = found.groupBy("host").agg(F.collect_list(F.struct("kind", "rules")).alias("rules"))
    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "host", "rules")
    schema = f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long"
    return joined.mapInArrow(_extract, schema)
