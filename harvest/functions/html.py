"""Selector-based extraction from HTML by an Arrow-batched map over a tree of one linear pass, and what regular expressions can't do."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable
from functools import lru_cache
from html.entities import html5
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    """An element: its place among its page's elements and texts (``i`` and ``p``, those inside up to ``end`` and ``q``), parsed attributes on demand."""

    __slots__ = ("_attrs", "children", "end", "i", "p", "page", "parent", "q", "raw", "tag", "text")

    def __init__(self, tag: str, raw: str, parent: Node | None, page: Page):
        self.tag, self.raw, self.parent, self.page, self.children, self.text, self._attrs = tag, raw, parent, page, [], "", None
        self.i, self.p = len(page.nodes), len(page.texts)
        self.end = self.q = None

    @property
    def attrs(self) -> dict[str, str]:
        """Values by lower-cased name, entities decoded; of two of one name the first."""
        if self._attrs is None:
            self._attrs = {}
            for name, value in _ATTRIBUTE.findall(self.raw):
                value = value[1:-1] if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1 else value.lstrip("\"'")
                self._attrs.setdefault(name.lower(), _html.unescape(value) if "&" in value else value)
        return self._attrs

    def all_text(self) -> str:
        return "".join(self.page.texts[self.p : self.q])

    def walk(self):
        """The elements inside, in document order."""
        return iter(self.page.nodes[self.i + 1 : self.end])


class Page:
    """All elements (the root first) and texts of a page in document order, and its elements by tag."""

    __slots__ = ("by_tag", "nodes", "texts")

    def __init__(self):
        self.nodes: list[Node] = []
        self.texts: list[str] = []
        self.by_tag: dict[str, list[Node]] = {}


_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]*))?""")
#: A comment, a declaration, or a tag; what is left open runs to the end of the page. Every alternative takes what it begins, so a page is
#: read in time linear in its length.
_TOKEN = re.compile(r"""<!--(?:.*?(?:-->|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)""", re.S)
_RAW = {t: re.compile(rf"</{t}[\s/>]|\Z", re.I) for t in ("script", "style")}


_ENDED = re.compile(r"&(?:(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,8})|([A-Za-z][A-Za-z0-9]{1,31}));")


def ended(s: str) -> str:
    """Entities decoded that end with a semicolon; a name without one, as a cut text has it, stays as written, where HTML decodes some."""
    return _ENDED.sub(lambda m: _html.unescape(m[0]) if m[1] or f"{m[2]};" in html5 else m[0], s)


def parse(page: str | None, decode: Callable[[str], str] = _html.unescape) -> Node:
    """The tree of a page of any markup, by one pass over its tokens; an end tag closes all up to its element, or nothing. ``decode``: of texts."""
    out, s, at = Page(), page or "", 0
    root = here = Node("", "", None, out)
    out.nodes.append(root)
    opened: dict[str, int] = {}

    def said(text: str) -> None:
        if text:
            text = decode(text) if "&" in text else text
            here.children.append(text)
            out.texts.append(text)

    while at < len(s):
        m = _TOKEN.search(s, at)
        said(s[at : m.start()] if m else s[at:])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if opened.get(name):
                while True:
                    here.end, here.q, closed = len(out.nodes), len(out.texts), here.tag
                    opened[closed] -= 1
                    here = here.parent
                    if closed == name:
                        break
            continue
        node = Node(name, m[3], here, out)
        here.children.append(node)
        out.nodes.append(node)
        out.by_tag.setdefault(name, []).append(node)
        if name in _RAW:
            end = _RAW[name].search(s, at)
            node.text, at = s[at : end.start()], end.start()
        if name in _VOID or m[3].endswith("/"):
            node.end, node.q = len(out.nodes), len(out.texts)
        else:
            here = node
            opened[name] = opened.get(name, 0) + 1
    while here is not None:
        here.end, here.q, here = len(out.nodes), len(out.texts), here.parent
    return root


_SIMPLE = re.compile(r"([a-z0-9*]*)((?:[.#][\w-]+|\[[^\]]+\])*)$", re.I)
_TESTS = {"": lambda have, value: True, "=": str.__eq__, "*=": str.__contains__, "^=": str.startswith, "$=": str.endswith}


@lru_cache(maxsize=1024)
def _compiled(simple: str) -> tuple[str, tuple, tuple]:
    """(tag or '', classes, (attribute, test, value)) of a selector without blanks."""
    m = _SIMPLE.match(simple)
    if not m:
        raise ValueError(f"selector {simple!r}")
    classes, tests = [], []
    for part in re.findall(r"[.#][\w-]+|\[[^\]]+\]", m[2]):
        if part[0] == ".":
            classes.append(part[1:])
        elif part[0] == "#":
            tests.append(("id", _TESTS["="], part[1:]))
        else:
            name, op, value = re.match(r"\[([\w-]+)(?:([*^$]?=)['\"]?([^'\"\]]*)['\"]?)?\]", part).groups()
            tests.append((name.lower(), _TESTS[op or ""], value or ""))
    return "" if m[1] == "*" else m[1].lower(), tuple(classes), tuple(tests)


@lru_cache(maxsize=1024)
def _parts(selector: str) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(s.replace(">", " > ").split()) for s in selector.split(","))


def _matches(node: Node, simple: str) -> bool:
    tag, classes, tests = _compiled(simple)
    if tag and node.tag != tag:
        return False
    if (classes or tests) and not node.raw:
        return False
    if classes and not set(classes) <= set(node.attrs.get("class", "").split()):
        return False
    return all((have := node.attrs.get(name)) is not None and test(have, value) for name, test, value in tests)


def _holds(node: Node, parts: tuple[str, ...], seen: dict) -> bool:
    """Whether a node fits a selector; ``seen`` keeps for elements whether they or what is around them fit its first parts."""
    if not _matches(node, parts[-1]):
        return False
    rest = parts[:-1]
    if not rest:
        return True
    if rest[-1] == ">":
        return node.parent is not None and bool(node.parent.tag) and _holds(node.parent, rest[:-1], seen)
    up, passed, fits = node.parent, [], False
    while up is not None and up.tag:
        key = (up.i, rest)
        if key in seen:
            fits = seen[key]
            break
        passed.append(key)
        if fits := _holds(up, rest, seen):
            break
        up = up.parent
    seen.update(dict.fromkeys(passed, fits))
    return fits


def select(root: Node, selector: str) -> list[Node]:
    """Nodes in document order: tags, classes, ids, attributes (=, *=, ^=, $=), descendants, children, comma lists."""
    wanted = _parts(selector)
    tags = {_compiled(w[-1])[0] for w in wanted}
    if "" in tags:
        some = root.walk()
    elif len(tags) == 1:
        some = root.page.by_tag.get(*tags, ())
    else:
        some = sorted((n for t in tags for n in root.page.by_tag.get(t, ())), key=lambda n: n.i)
    seen: dict = {}
    return [n for n in some if root.i < n.i < root.end and any(_holds(n, w, seen) for w in wanted)]


def closest(node: Node | None, simple: str) -> Node | None:
    while node is not None and node.tag and not _matches(node, simple):
        node = node.parent
    return node if node is not None and node.tag else None


def after(node: Node, stop: str | None = None, only: str | None = None) -> list[Node]:
    """Siblings behind a node, up to one that ``stop`` matches, those that ``only`` matches."""
    if node.parent is None:
        return []
    own = [c for c in node.parent.children if isinstance(c, Node)]
    out = []
    for c in own[own.index(node) + 1 :]:
        if stop and any(_matches(c, s.strip()) for s in stop.split(",")):
            break
        if not only or _matches(c, only):
            out.append(c)
    return out


def compact(s: str) -> str:
    return " ".join(s.split())


@F.pandas_udf(T.StringType())
def resolve_any(href: pd.Series, base: pd.Series) -> pd.Series:
    """Any relative reference against its base, dot segments removed, without fragment; '' for what can't be parsed."""

    def one(h, b):
        try:
            return urldefrag(urljoin(b or "", (h or "").strip()))[0]
        except ValueError:
            return ""

    return pd.Series([one(h, b) for h, b in zip(href, base, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Tags to spaces, every entity decoded, white space compacted."""
    return s.map(lambda x: None if x is None else compact(_html.unescape(re.sub("<[^>]*>", " ", x))))


# Places of a posting's description, location and date, by priority.
DESCRIPTIONS = (".job-description", ".description", "article", ".content", "main", "#description")
LOCATIONS = (".location", "[data-location]", ".job-location")
DATES = ("[data-posted-date]", ".posted-date", "time")


def details_udf(decode: Callable[[str], str] = _html.unescape):
    """A function column: title (h1, else title), description (the first of six places with over 100 bytes), location, e-mail, phone, date.

    Of each place its first element counts; the date is the last of its three places that has one (RFC 3339).
    ``decode``: of texts.
    """

    @F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "description", "location", "email", "phone", "date")]))
    def run(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            root = parse(page, decode)
            first = lambda sel: next((compact(n.all_text()) for n in select(root, sel)), "")  # noqa: E731, B023
            title = first("h1" if "h1" in root.page.by_tag else "title")
            description = next((t for sel in DESCRIPTIONS if len((t := first(sel)).encode()) > 100), "")
            location = next((t for sel in LOCATIONS if (t := first(sel))), "")
            whole = root.all_text()
            email = next(iter(re.findall(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", whole)), "") if "@" in whole else ""
            phone = re.search(r"[\+]?[0-9]{1,4}[\s\-\.]?[0-9]{1,4}[\s\-\.]?[0-9]{1,9}", whole, re.A)
            date = ""
            for sel in DATES:
                for n in select(root, sel)[:1]:
                    d = n.attrs.get("datetime") or compact(n.all_text())
                    date = d if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", d) else date
            rows.append((title, description, location, email, phone.group(0).strip() if phone else "", date))
        return pd.DataFrame(rows, columns=["title", "description", "location", "email", "phone", "date"])

    return run


page_details = details_udf()


def bullets(headings: str = "h2,h3,h4,strong", names: tuple[str, ...] = ("responsibilities", "requirements")):
    """A function column: list items behind the headings with these words, responsibilities first."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            root = parse(page)
            found: list[str] = []
            for name in names:
                for h in select(root, headings):
                    if name in h.all_text().lower():
                        for block in after(h, stop=headings):
                            items = [block] if block.tag == "li" else [n for n in block.walk() if n.tag == "li"]
                            found += [t for n in items if (t := compact(n.all_text()))]
                        break
            out.append(found)
        return pd.Series(out)

    return run


# What announces a phone, by priority, and the first digits of local numbers.
PHONE_MARKERS = ("phone:", "tel:", "call:", "contact:", "call us", "phone us", "tel us", "ליצור קשר", "טלפון")
LOCAL_PREFIXES = ("05", "02", "03", "04", "08", "09")


def valid_phone(p: str) -> bool:
    """The rule of ``contact.valid_phone``."""
    p = p.strip()
    d = "".join(c for c in p if "0" <= c <= "9")
    half = len(d) // 2
    if p.startswith("-") or not 8 <= len(d) <= 13 or len(set(d)) == 1 or d.count("0") > half or (len(d) % 2 == 0 and d[:half] == d[half:]):
        return False
    local = len(d) == 10 and d.startswith((*LOCAL_PREFIXES, "077")) or len(d) in (9, 10) and d.startswith("972")
    return local or p.startswith("+") and len(d) >= 10


def normal_phone(p: str) -> str:
    """The form of ``contact.normal_phone``."""
    p = p.strip()
    d = "".join(c for c in p if "0" <= c <= "9")
    if d.startswith("972") and len(d) >= 12:
        return f"+972-{d[-11:-9]}-{d[-9:-6]}-{d[-6:]}"
    return f"{d[:3]}-{d[3:6]}-{d[6:]}" if d.startswith("0") and len(d) == 10 else p


def phone_groups(s: str) -> str:
    """A number from a text's digit groups: three of 2 or 3, 3 and 4 or more digits, or two; '' for any other."""
    g = re.findall("[0-9]+", s)
    if len(g) == 3 and len(g[0]) in (2, 3) and len(g[1]) == 3 and len(g[2]) >= 4 and g[0].startswith(LOCAL_PREFIXES) and valid_phone("".join(g)):
        return "-".join(g)
    return "".join(g) if len(g) == 2 and valid_phone("".join(g)) else ""


def phone_in(s: str) -> str:
    """The first phone of a text in normal form: right behind tel:, a word of valid form, or by its digit groups."""
    s = (s or "").strip()
    if m := re.search(r"tel:([^ \n\r\t\"'<>]*)", s, re.I):
        if valid_phone(m[1]):
            return normal_phone(m[1])
    for word in re.sub(r"[^0-9 ()+-]", "", re.sub(r"[\n\r\t]", " ", s)).split():
        if not word.startswith("-") and valid_phone(p := re.sub("[()]", "", word)):
            return normal_phone(p)
    found = phone_groups(s)
    return normal_phone(found) if found else ""


def phone_announced_in(s: str) -> str:
    """The phone behind tel: as written, else behind the first marker that leads to one, else anywhere."""
    s = (s or "").strip()
    if m := re.search(r"tel:\s*([^ \n\r\t<>]+)", s, re.I):
        if valid_phone(p := m[1].strip(".,;:!?\"'()[]{}")):
            return p
    low = s.lower()
    tails = [s[low.index(m) + len(m) :] for m in PHONE_MARKERS if m in low]
    return next((p for t in [*tails, s] if (p := phone_in(t))), "")


@F.pandas_udf(T.StringType())
def find_phone(s: pd.Series) -> pd.Series:
    return pd.Series([phone_in(x) for x in s], dtype=object)


@F.pandas_udf(T.StringType())
def phone_announced(s: pd.Series) -> pd.Series:
    return pd.Series([phone_announced_in(x) for x in s], dtype=object)
