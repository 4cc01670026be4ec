"""Lines of text of an HTML page, each with what the page's markup says about it.

A line is the text of a block: what stands between two block tags or line breaks, with character references
decoded, white space turned into one space and trimmed; empty ones are left out. Kinds:

- ARTICLE: inside `article` or `main`, unless it is chrome;
- CHROME: inside an element that is no running text by its name (menus, footers, sidebars, forms, ...), its role, or
  the words of its class and id;
- OPEN: neither; the markup does not decide.

Any input gives a result: unclosed, stray and crossing tags are closed as browsers do in simple cases, an
unterminated comment, script or tag ends with the page. The work is linear in the page's length.
"""

from __future__ import annotations

import html
import re

OPEN, ARTICLE, CHROME = 0, 1, 2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td"
    " tfoot th thead title tr ul br".split()
)
CHROME_NAMES = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head iframe label math menu nav noscript object search select"
    " svg template textarea title video".split()
)
RAW = frozenset("script style iframe noembed noframes xmp title textarea".split())
CHROME_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus"
    " footer masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted"
    " recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar"
    " widget widgets".split()
)
KEPT_NAMES = frozenset("html body main".split())  # whatever their classes say
OTHER_ARTICLES = frozenset("ad advert comment comments comment-body promo related reply sponsored".split())  # classes of articles that are not the page's

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_OPEN_QUOTE = re.compile(r"""=\s*(["'])""")
_WORDS = re.compile(r"[A-Za-z][a-z]*")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}
_ASKED = ("class", "id", "role", "hidden", "aria-hidden")


def is_chrome(name: str, attributes: str, in_article: bool) -> bool:
    if name in CHROME_NAMES or (name == "header" and not in_article):
        return True
    if not attributes or name in KEPT_NAMES or not any(a in attributes.lower() for a in _ASKED):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if name == "article" and key in ("class", "id"):
            if OTHER_ARTICLES & set(value.lower().split()):
                return True
            continue
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "role" and value.lower() in CHROME_ROLES:
            return True
        if key in ("class", "id"):
            words = {w.lower() for w in _WORDS.findall(value)}
            if words & CHROME_WORDS or ("header" in words and not in_article):
                return True
    return False


class _Page:
    """One pass over a page: a stack of open elements and the line being gathered."""

    def __init__(self):
        self.lines: list[tuple[int, str]] = []
        self.stack: list[tuple[str, int, bool, int]] = []  # name, kind, inside article, place of an open p or -1
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.kind = OPEN

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(map(html.unescape, self.parts)).split())  # no reference crosses a tag
            if text:
                self.lines.append((self.kind, text))
            self.parts = []

    def text(self, piece: str) -> None:
        kind = self.stack[-1][1] if self.stack else OPEN
        if kind != self.kind:
            self.flush()
            self.kind = kind
        self.parts.append(piece)

    def cut(self, size: int) -> None:
        for name, *_ in self.stack[size:]:
            self.open[name] -= 1
        del self.stack[size:]

    def start(self, name: str, attributes: str, closed: bool) -> None:
        if name in BLOCKS:
            self.flush()
            if name != "br" and self.stack and self.stack[-1][3] >= 0:
                self.cut(self.stack[-1][3])  # a block ends an open paragraph
        if name in VOID or (closed and name in ("svg", "math", "path")):
            return
        _, kind, inside, paragraph = self.stack[-1] if self.stack else ("", OPEN, False, -1)
        if kind != CHROME:
            inside = inside or name in ("article", "main")
            kind = CHROME if is_chrome(name, attributes, inside) else ARTICLE if inside else OPEN
        place = len(self.stack) if name == "p" else -1 if name in BLOCKS else paragraph
        self.stack.append((name, kind, inside, place))
        self.open[name] = self.open.get(name, 0) + 1

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        if self.open.get(name):
            size = len(self.stack) - 1
            while self.stack[size][0] != name:
                size -= 1
            self.cut(size)


def page_lines(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of every line of a page, in page order."""
    page = page or ""
    out = _Page()
    n, at = len(page), 0
    missing: set[str] = set()  # quotes that do not occur again
    while at < n:
        less = page.find("<", at)
        if less < 0:
            out.text(page[at:])
            break
        if less > at:
            out.text(page[at:less])
        if page.startswith("<!--", less):
            stop = page.find("-->", less + 4)
            if page[less + 4 : less + 5] == ">":
                stop = less + 2
            at = n if stop < 0 else stop + 3
            continue
        if page[less + 1 : less + 2] in ("!", "?") and less + 1 < n:
            stop = page.find(">", less)
            at = n if stop < 0 else stop + 1
            continue
        tag = _TAG.match(page, less)
        if not tag:
            if page.startswith("</", less) and less + 2 < n:
                stop = page.find(">", less)
                at = n if stop < 0 else stop + 1
            else:
                out.text("&lt;")
                at = less + 1
            continue
        name = tag[2].lower()
        stop, done = page.find(">", tag.end()), tag.end()
        while stop >= 0 and (opened := _OPEN_QUOTE.search(_QUOTED.sub("", page[done:stop]))) and opened[1] not in missing:
            quote = page.find(opened[1], stop)  # this > stands inside a quoted value
            further = page.find(">", quote) if quote >= 0 else -1
            if further < 0:
                missing.add(opened[1])
                break
            done, stop = quote + 1, further
        if stop < 0:
            break
        at = stop + 1
        if tag[1]:
            out.end(name)
            continue
        rest = page[tag.end() : stop]
        out.start(name, rest, rest.endswith("/"))
        if name in RAW:
            close = _RAW_END[name].search(page, at)
            at = close.start() if close else n
        elif name == "plaintext":
            at = n
    out.flush()
    return out.lines
