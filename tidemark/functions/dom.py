"""HTML: a tree builder on the standard parser, extraction of main content, and profiles of a page.

Trees only live inside Arrow-batched functions; what leaves them are columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import bound

#: Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(("script", "style", "noscript"))
BOILERPLATE_TAGS = frozenset(("nav", "footer", "header", "aside"))
BOILERPLATE_WORDS = ("sidebar", "footer", "header", "nav", "menu", "breadcrumb", "cookie", "banner", "advert", "social", "share", "comment", "related", "widget", "popup", "modal")
BOILERPLATE_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary"))
CONTENT_TAGS = frozenset("p article section div main td th li dd dt blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 span details summary body".split())
LANDMARKS = frozenset(("main", "article", "section", "nav", "header", "footer", "aside"))
SPA_MARKERS = ('id="root"></div>', 'id="app"></div>', 'id="__next"></div>', "window.__initial_state__", "ng-app")
HIDDEN = tuple(re.compile(p, re.I) for p in (r"display\s*:\s*none", r"visibility\s*:\s*hidden", r"font-size\s*:\s*0[^1-9]", r"opacity\s*:\s*0[^.]", r"position\s*:\s*absolute[^;]*-\d{4,}"))
ALLOWED = frozenset("a abbr b blockquote br caption code col colgroup dd del div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img ins li ol p pre q s small span strong sub sup table tbody td tfoot th thead tr u ul".split())
#: Tags whose start ends an open element of these tags.
CLOSES = {
    **{t: ("p",) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
#: Elements beyond which an implied end does not reach.
BARRIERS = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "dt": ("dl",), "dd": ("dl",)}
HEAD_TAGS = frozenset(("title", "meta", "link", "base", "style", "script", "noscript"))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "data")

    def __init__(self, tag: str | None, attrs=(), data: str = "", parent: Node | None = None):
        self.tag, self.data, self.parent = tag, data, parent
        self.attrs: list[tuple[str, str]] = [(k, v or "") for k, v in attrs]
        self.children: list[Node] = []

    def get(self, key: str) -> str:
        return next((v for k, v in self.attrs if k == key), "")

    def has(self, key: str) -> bool:
        return any(k == key for k, _ in self.attrs)

    def walk(self, skip: Callable[[Node], bool] | None = None) -> Iterator[Node]:
        """The node and all below in document order; below a node that skip names nothing."""
        stack = [self]
        while stack:
            n = stack.pop()
            if skip and n.tag and skip(n):
                continue
            yield n
            stack.extend(reversed(n.children))

    def elements(self) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.html = self._add(self.root, Node("html"))
        self.head, self.body = self._add(self.html, Node("head")), None
        self.stack = [self.html]
        self.in_head = True

    @staticmethod
    def _add(parent: Node, child: Node) -> Node:
        child.parent = parent
        parent.children.append(child)
        return child

    def _open_body(self) -> None:
        if self.body is None:
            self.body = self._add(self.html, Node("body"))
            self.stack = [self.html, self.body]
        self.in_head = False

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            self.html.attrs += [(k, v or "") for k, v in attrs if not self.html.has(k)]
            return
        if tag == "head":
            return
        if tag == "body":
            self._open_body()
            self.body.attrs += [(k, v or "") for k, v in attrs if not self.body.has(k)]
            return
        if self.in_head:
            if tag in HEAD_TAGS:
                node = self._add(self.head, Node(tag, attrs))
                if tag not in VOID:
                    self.stack = [self.html, self.head, node]
                return
            self._open_body()
        for open_tag in CLOSES.get(tag, ()):
            for i in range(len(self.stack) - 1, 1, -1):
                name = self.stack[i].tag
                if name == open_tag:
                    del self.stack[i:]
                    break
                if name in BARRIERS.get(open_tag, ("table", "td", "th", "button", "li") if open_tag == "p" else ()):
                    break
        node = self._add(self.stack[-1], Node(tag, attrs))
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.stack) > 2 and self.stack[-1].tag == tag:
            pass  # a slash does not close an element that is not void

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "head":
            self._open_body()
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag and self.stack[i] is not self.body:
                del self.stack[i:]
                break
        if self.in_head and self.stack == [self.html]:
            self.stack = [self.html]
        if self.in_head and self.stack[-1] is self.head:
            self.stack = [self.html]

    def handle_data(self, data):
        top = self.stack[-1]
        if self.in_head and (top is self.html or top is self.head):
            if not data.strip():
                return
            self._open_body()
            top = self.body
        if top.children and top.children[-1].tag is None:
            top.children[-1].data += data
        else:
            self._add(top, Node(None, data=data))


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    if b.body is None:
        b._open_body()
    return b.root


def _tags(n: Node) -> tuple[str, str]:
    """What stands before and after the children of an element."""
    if n.tag == "#document":
        return "", ""
    attrs = "".join(f' {k}="{escape(v, quote=True)}"' for k, v in n.attrs)
    return (f"<{n.tag}{attrs}/>", "") if n.tag in VOID else (f"<{n.tag}{attrs}>", f"</{n.tag}>")


def _shown(n: Node) -> str:
    """A text node as HTML."""
    return n.data if n.parent is not None and n.parent.tag in ("script", "style") else escape(n.data, quote=False)


def _written(top: Node, tags: Callable[[Node], tuple[str, str] | None], shown: Callable[[Node], str]) -> str:
    """HTML of a subtree; tags gives what stands around an element's children, or None to leave it out. Of any depth."""
    out: list[str] = []
    stack: list[Node | str] = [top]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag is None:
            out.append(shown(n))
        elif (around := tags(n)) is not None:
            out.append(around[0])
            stack.append(around[1])
            if n.tag not in VOID:
                stack.extend(reversed(n.children))
    return "".join(out)


def render(n: Node) -> str:
    """The subtree as HTML text."""
    return _written(n, _tags, _shown)


def folded(top: Node, f: Callable[[Node, list], object]):
    """f of a node and of what it gave for the node's children, from the leaves up. Of any depth."""
    order, stack = [], [top]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(n.children)
    got: dict[int, object] = {}
    for n in reversed(order):
        got[id(n)] = f(n, [got.pop(id(c)) for c in n.children])
    return got[id(top)]


def text_of(n: Node, clean: bool = False) -> str:
    """Trimmed text nodes joined by spaces, without scripts and styles; clean leaves out boilerplate as well."""
    return " ".join(t for x in n.walk(lambda e: e.tag in SKIPPED or (clean and is_boilerplate(e))) if x.tag is None and (t := x.data.strip()))


def visible_text(n: Node) -> str:
    return " ".join(t for x in n.walk(lambda e: e.tag in SKIPPED or is_hidden(e)) if x.tag is None and (t := x.data.strip()))


def link_text(top: Node) -> str:
    """Text inside links, without separators."""
    out, stack = [], [(top, False)]
    while stack:
        n, inside = stack.pop()
        inside = inside or n.tag == "a"
        if n.tag is None and inside:
            out.append(n.data.strip())
        stack.extend((c, inside) for c in reversed(n.children))
    return "".join(out)


def sizes(top: Node) -> dict[int, tuple[int, int, int, int]]:
    """Of every element below, by id: bytes of text_of, of link_text, of trimmed text, and of render; in one pass."""
    out: dict[int, tuple[int, int, int, int]] = {}

    def measure(n: Node, kids: list) -> tuple:
        if n.tag is None:
            t = bytes_of(n.data.strip())
            return t, int(t > 0), 0, t, bytes_of(_shown(n))
        text, count, links, every, shown = (sum(k[i] for k in kids) for i in range(5))
        if n.tag in SKIPPED:
            text = count = 0
        a, b = _tags(n)
        shown = bytes_of(a) + bytes_of(b) + (0 if n.tag in VOID else shown)
        links = every if n.tag == "a" else links
        out[id(n)] = (text + max(0, count - 1), links, text, shown)
        return text, count, links, every, shown

    folded(top, measure)
    return out


def is_boilerplate(n: Node) -> bool:
    if n.tag in BOILERPLATE_TAGS:
        return True
    for k, v in n.attrs:
        if k in ("class", "id") and any(w in v.lower() for w in BOILERPLATE_WORDS):
            return True
        if k == "role" and v in BOILERPLATE_ROLES:
            return True
    return False


def is_hidden(n: Node) -> bool:
    style = n.get("style")
    return bool(style) and any(p.search(style) for p in HIDDEN)


def title_of(doc: Node) -> str:
    """Of several titles the last one counts."""
    titles = [n for n in doc.elements() if n.tag == "title"]
    return next((t.children[0].data.strip() for t in reversed(titles) if t.children), "")


def first_title(doc: Node) -> str:
    return next((t for n in doc.elements() if n.tag == "title" and (t := text_of(n))), "")


def bytes_of(s: str) -> int:
    return len(s.encode())


# -- selectors --------------------------------------------------------------------------------------------------------

_SELECTOR = re.compile(r"^(?P<tag>[^.#\[]*)(?:\.(?P<cls>[^#\[]*))?(?:#(?P<id>[^\[]*))?(?:\[(?P<attr>.*))?$", re.S)


def _simple(selector: str) -> Callable[[Node], bool]:
    """Matcher of tag, one class, one id and one attribute; a class written with a further dot is taken literally."""
    m = _SELECTOR.match(selector)
    if not m:  # an id before a class belongs to the id as a whole
        head, _, attr = selector.partition("[")
        tag, _, name = head.partition("#")
        m = {"tag": tag, "cls": None, "id": name, "attr": attr or None}
    tag, cls, name, attr = m["tag"], m["cls"], m["id"], m["attr"]
    key, eq, value = ((attr or "").rstrip("]")).partition("=")
    value = value.strip("\"'")

    def ok(n: Node) -> bool:
        if tag and n.tag != tag or name and n.get("id") != name or cls and cls not in n.get("class").split():
            return False
        return not key or (n.get(key) == value if eq and value else n.has(key))

    return ok


def select(doc: Node, selector: str) -> list[Node]:
    """Nodes of a descendant selector; each part looks at a match itself too, and repeated matches stay."""
    found = [doc]
    parts = selector.split()
    for part in parts:
        ok = _simple(part)
        found = [n for top in found for n in top.elements() if n.tag != "#document" and ok(n)]
    return found if parts else []


_STEP = re.compile(r"^([^\[]*)(?:\[(.*)\])?$", re.S)


def _step(step: str) -> Callable[[Node], bool]:
    m = _STEP.match(step.strip())
    tag, predicate = (m[1], m[2] or "") if m else (step, "")

    def ok(n: Node) -> bool:
        if not n.tag or n.tag == "#document" or tag not in ("", "*") and n.tag != tag:
            return False
        if predicate.isdigit():
            same = [c for c in (n.parent.children if n.parent else [n]) if c.tag == n.tag]
            return same.index(n) + 1 == int(predicate)
        if predicate.startswith("@"):
            key, eq, value = predicate[1:].partition("=")
            return n.get(key) == value.strip("\"'") if eq else n.has(key)
        return True

    return ok


def xpath(doc: Node, path: str) -> list[Node]:
    """Nodes of a path: '//' or nothing in front searches everywhere for the first step, '/' starts at the document; then children."""
    path = path.strip()
    absolute = path.startswith("/") and not path.startswith("//")
    steps = path.lstrip("/").split("/") if not absolute else path[1:].split("/")
    found = [doc]
    for i, step in enumerate(s for s in steps if s):
        ok = _step(step)
        if i == 0 and not absolute:
            found = [n for n in doc.elements() if ok(n)]
        else:
            found = [c for n in found for c in n.children if ok(c)]
    return found


# -- main content -----------------------------------------------------------------------------------------------------


def log_scale(n: int) -> float:
    steps = 0
    while n > 100:
        n, steps = n // 2, steps + 1
    return 1.0 + steps if n > 0 or steps else 0.0


def _joined(nodes: list[Node], least: int) -> tuple[str, str] | None:
    got = [(t, render(n)) for n in nodes if bytes_of(t := text_of(n)) >= least]
    return ("\n\n".join(t for t, _ in got), "\n".join(h for _, h in got)) if got else None


def densest(body: Node, least: int) -> Node | None:
    """The element of the highest density times length scale times share outside links; more than half links is passed over."""
    best, high, measured = None, 0.0, sizes(body)
    for n in body.walk(is_boilerplate):
        if n.tag is None or n.tag not in CONTENT_TAGS:
            continue
        size, links, _, shown = measured[id(n)]
        if size < least or not size:
            continue
        links /= size
        score = size / max(1, shown) * log_scale(size) * (1 - links)
        if links <= 0.5 and score > high:
            best, high = n, score
    return best


def by_density(doc: Node, least: int) -> tuple[str, str]:
    for tag in ("main", "article"):
        marked = [n for n in doc.elements() if n.tag == tag]
        if marked:
            got = _joined([n for n in marked if not is_boilerplate(n)], least)
            if got:
                return got
            break
    body = next((n for n in doc.elements() if n.tag == "body"), doc)
    best = densest(body, least)
    if best is not None:
        return text_of(best), render(best)
    text = text_of(body, clean=True)
    return (text, render(body)) if bytes_of(text) >= least else ("", "")


def extract(html: str, mode: str = "auto", selectors: list[str] | None = None, least: int = 50) -> dict:
    """title, text, html, hash (of the text as extracted) and error of a page."""
    doc = parse(html)
    title = title_of(doc)
    selectors, mode, error = selectors or [], mode or "auto", None
    got: tuple[str, str] | None = None
    if mode in ("css", "xpath"):
        find = select if mode == "css" else xpath
        got = _joined([n for s in selectors for n in find(doc, s)], least)
        error = None if got else "no content matched"
    elif mode == "auto" and selectors:
        got = _joined([n for s in selectors for n in select(doc, s)], least)
    elif mode not in ("auto", "density"):
        error = f"unknown mode: {mode}"
    if got is None and error is None:
        got = by_density(doc, least)
    text, body = got or ("", "")
    return {"title": title, "text": text, "html": body, "hash": hashlib.sha256(text.encode()).hexdigest() if error is None else None, "error": error}


# -- profiles ---------------------------------------------------------------------------------------------------------


def path_of(n: Node) -> str:
    """Path with an index only among several siblings of one tag."""
    parts = []
    while n.parent is not None:
        same = [c for c in n.parent.children if c.tag == n.tag]
        parts.append(n.tag + (f"[{same.index(n) + 1}]" if len(same) > 1 else ""))
        n = n.parent
    return "/" + "/".join(reversed(parts))


def split_bytes(n: Node) -> tuple[int, int]:
    """Bytes of text (not of scripts and styles) and of the rest of the markup."""
    text = sum(bytes_of(x.data.strip()) for x in n.walk(lambda e: e.tag in SKIPPED) if x.tag is None)
    return text, max(0, bytes_of(render(n)) - text)


def skeleton(doc: Node) -> str:
    out, stack = [], [(c, 0) for c in reversed(doc.children)]
    while stack:
        n, depth = stack.pop()
        if n.tag:
            out.append(f"{depth}:{n.tag};")
            if n.tag not in VOID:
                stack.extend((c, depth + 1) for c in reversed(n.children))
    return "".join(out)


def fingerprint(doc: Node) -> str:
    """Hex of the first 16 bytes of the SHA-256 of the skeleton."""
    return hashlib.sha256(skeleton(doc).encode()).hexdigest()[:32]


def landmarks(doc: Node) -> list[dict]:
    return [{"tag": n.tag, "xpath": path_of(n), "role": n.get("role")} for n in doc.elements() if n.tag in LANDMARKS]


def densities(doc: Node) -> dict[str, float]:
    body = next((n for n in doc.elements() if n.tag == "body"), None)
    out = {}
    for c in body.children if body else []:
        if c.tag:
            text, rest = split_bytes(c)
            if text + rest:
                out[path_of(c)] = round(text / (text + rest), 3)
    return out


def content_selectors(doc: Node, most: int = 10) -> list[str]:
    name = lambda n: n.tag + (f"#{n.get('id')}" if n.get("id") else f".{n.get('class').split()[0]}" if n.get("class").split() else "")
    measured = sizes(doc)
    out = [name(n) for n in doc.elements() if n.tag in ("main", "article", "section") and measured[id(n)][0] > 100]
    if not out:
        for n in doc.elements():
            if n.tag == "div":
                _, _, text, shown = measured[id(n)]
                if text > 200 and text / max(1, text + max(0, shown - text)) > 0.3:
                    out.append(name(n))
    return out[:most]


def sufficient(html: str, doc: Node | None = None) -> bool:
    """Whether a page can be read without running it: long enough, enough text for its markup, no single-page shell."""
    raw = html or ""
    if bytes_of(raw) < 256 or any(m in raw.lower() for m in SPA_MARKERS):
        return False
    body = next((n for n in (doc or parse(raw)).elements() if n.tag == "body"), None)
    if body is None:
        return False
    text, rest = split_bytes(body)
    solid = sum(bytes_of("".join(x.data.split())) for x in body.walk(lambda e: e.tag in SKIPPED) if x.tag is None)
    return text / max(1, text + rest) >= 0.10 and solid >= 200


def profile(html: str) -> dict:
    """landmarks, content_selectors, fingerprint, sufficient and densities of a page, which is parsed once."""
    doc = parse(html)
    return {"landmarks": landmarks(doc), "content_selectors": content_selectors(doc), "fingerprint": fingerprint(doc), "sufficient": sufficient(html, doc), "densities": densities(doc)}


def _sanitised(doc: Node) -> str:
    def tags(n: Node) -> tuple[str, str] | None:
        if n.tag in SKIPPED or n.tag in ("head", "iframe", "object", "template"):
            return None
        if n.tag not in ALLOWED:
            return "", ""
        keep = {"a": ("href",), "img": ("src", "alt")}.get(n.tag, ())
        attrs = "".join(f' {k}="{escape(v, quote=True)}"' for k, v in n.attrs if k in keep and not v.strip().lower().startswith(("javascript:", "data:", "vbscript:")))
        return (f"<{n.tag}{attrs}/>", "") if n.tag in VOID else (f"<{n.tag}{attrs}>", f"</{n.tag}>")

    return _written(doc, tags, lambda n: escape(n.data, quote=False)).strip()


def sanitise(html: str) -> str:
    """Allowed elements only, with href on links and src and alt on images; scripts, styles and the rest of the tags go."""
    return _sanitised(parse(html))


def strip_tags(html: str) -> str:
    return text_of(parse(html))


def _inline(top: Node) -> str:
    def one(n: Node, kids: list) -> str:
        if n.tag is None:
            return re.sub(r"\s+", " ", n.data)
        inner = "".join(kids)
        if n.tag in ("strong", "b") and inner.strip():
            return f"**{inner.strip()}**"
        if n.tag in ("em", "i") and inner.strip():
            return f"*{inner.strip()}*"
        if n.tag == "code":
            return f"`{inner}`"
        if n.tag == "a" and n.get("href"):
            return f"[{inner.strip()}]({n.get('href')})"
        if n.tag == "img":
            return f"![{n.get('alt')}]({n.get('src')})"
        return "\n" if n.tag == "br" else inner

    return folded(top, one)


_BLOCKS = frozenset("p div section article main blockquote figure body html dl dd dt".split())


def _markdown(clean: str) -> str:
    """Markdown of sanitised HTML."""
    out: list[str] = []
    # elements that are being written, each with what is left of its children, its indent, and inline text not yet put out
    frames: list[tuple[Iterator[Node], str, list[str]]] = [(iter(parse(clean).children), "", [])]

    def flush(indent: str, run: list[str]) -> None:
        if (t := "".join(run).strip()) and not out or t:
            out.append(indent + t)
        run.clear()

    while frames:
        kids, indent, run = frames[-1]
        c = next(kids, None)
        if c is None:
            flush(indent, run)
            frames.pop()
        elif c.tag and re.fullmatch(r"h[1-6]", c.tag):
            flush(indent, run)
            out.append("#" * int(c.tag[1]) + " " + _inline(c).strip())
        elif c.tag in ("ul", "ol"):
            flush(indent, run)
            items = [x for x in c.children if x.tag == "li"]
            out.append("\n".join(f"{indent}{f'{i}.' if c.tag == 'ol' else '-'} {_inline(x).strip()}" for i, x in enumerate(items, 1)))
        elif c.tag == "pre":
            flush(indent, run)
            out.append("```\n" + "".join(x.data for x in c.walk() if x.tag is None).strip("\n") + "\n```")
        elif c.tag == "table":
            flush(indent, run)
            rows = [[_inline(x).strip() for x in r.children if x.tag in ("td", "th")] for r in c.elements() if r.tag == "tr"]
            if rows:
                out.append("\n".join(["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:])]))
        elif c.tag == "hr":
            flush(indent, run)
            out.append("---")
        elif c.tag in _BLOCKS:
            flush(indent, run)
            frames.append((iter(c.children), indent + ("> " if c.tag == "blockquote" else ""), []))
        else:
            run.append(_inline(c))
    return "\n\n".join(x for x in out if x.strip()).strip()


def to_markdown(html: str, fallback: str = "") -> str:
    """Headings, paragraphs, lists, links, emphasis, code and tables as Markdown; an empty result gives the text of fallback."""
    return _markdown(sanitise(html)) or strip_tags(fallback)


# -- columns ----------------------------------------------------------------------------------------------------------


def _mapped(kind: str, f: Callable, *args):
    bound()

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x, *args) for x in s], index=s.index, dtype=object)

    return run


def _tried(html: str, *args) -> dict:
    """extract, with what goes wrong on a page as its error."""
    try:
        return extract(html, *args)
    except (ArithmeticError, AssertionError, AttributeError, LookupError, RecursionError, TypeError, ValueError) as e:
        return {"title": "", "text": "", "html": "", "hash": None, "error": f"{type(e).__name__}: {e}"}


def extract_column(html: Column | str, mode: str = "auto", selectors: list[str] | None = None, least: int = 50) -> Column:
    """struct<title, text, html, hash, error> of a page."""

    bound()

    @F.pandas_udf("title string, text string, html string, hash string, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_tried(x, mode, selectors, least) for x in s], columns=["title", "text", "html", "hash", "error"], dtype=object)

    return run(html)


def title_column(html: Column | str) -> Column:
    return _mapped("string", lambda x: title_of(parse(x)))(html)


def text_column(html: Column | str) -> Column:
    return _mapped("string", lambda x: text_of(parse(x)))(html)


def sufficient_column(html: Column | str) -> Column:
    return _mapped("boolean", sufficient)(html)


def fingerprint_column(html: Column | str) -> Column:
    return _mapped("string", lambda x: fingerprint(parse(x)))(html)


def landmarks_column(html: Column | str) -> Column:
    return _mapped("array<struct<tag:string,xpath:string,role:string>>", lambda x: landmarks(parse(x)))(html)


def densities_column(html: Column | str) -> Column:
    return _mapped("map<string,double>", lambda x: densities(parse(x)))(html)


def selectors_column(html: Column | str) -> Column:
    return _mapped("array<string>", lambda x: content_selectors(parse(x)))(html)


def sanitise_column(html: Column | str) -> Column:
    return _mapped("string", sanitise)(html)


def markdown_column(html: Column | str) -> Column:
    return _mapped("string", lambda x: to_markdown(x, x))(html)


def profile_column(html: Column | str) -> Column:
    """struct<landmarks, content_selectors, fingerprint, sufficient, densities> of a page, which is parsed once."""
    kind = "landmarks array<struct<tag:string,xpath:string,role:string>>, content_selectors array<string>, fingerprint string, sufficient boolean, densities map<string,double>"
    names = [x.split()[0] for x in kind.split(", ")]

    bound()

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dict.fromkeys(names) if x is None else profile(x) for x in s], columns=names, dtype=object)

    return run(html)


def clean_column(html: Column | str) -> Column:
    """struct<sanitised, markdown> of a page, whose sanitised form is made once."""

    bound()

    @F.pandas_udf("sanitised string, markdown string")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            clean = None if x is None else sanitise(x)
            rows.append({"sanitised": clean, "markdown": None if x is None else _markdown(clean) or strip_tags(x)})
        return pd.DataFrame(rows, columns=["sanitised", "markdown"], dtype=object)

    return run(html)
